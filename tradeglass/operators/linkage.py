"""Deduplication, merging and linkage of records, keyed by report.

Keep-first rules are aggregates over an ordinal, so they combine map-side and no group
is collected. Where a greedy scan decides in the original order, the smallest ordinal
decides here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions.text import (
    account_number_key, add, canonical_subscriber, either, first_meaningful, identity_key, is_missing, match_text, norm_text,
    number_tail, rx, solid_tail,
)
from tradeglass.operators.skew import contains_join, grouped_rank, salted_join
from tradeglass.session import stored


def keep_first(df: DataFrame, key: dict[str, str], ord_: str = "ord") -> DataFrame:
    """First row per key expressions by ordinal; ordinals are unique."""
    rows = F.expr(f"min_by(struct(*), {ord_}) AS r")
    names = list(key)
    return add(df, key).groupBy(*names).agg(rows).selectExpr("r.*").drop(*names)


def merged_field(name: str) -> str:
    """First present value, unless it is empty-like and unprotected and a later one says more.

    <name> is the value (null = field absent) and <name>_state its cell state; a value
    proven blank or explicitly not reported is never replaced.
    """
    present = f"if({name} IS NOT NULL, ord, NULL)"
    telling = f"if({name} IS NOT NULL AND {name} NOT IN ('', 'Not reported'), ord, NULL)"
    return (f"if(min_by({name}_state, {present}) IN ('blank', 'explicit_not_reported'), min_by({name}, {present}), "
            f"coalesce(min_by({name}, {telling}), min_by({name}, {present}))) AS {name}")


def merge_records(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One record per key: fields merged in ordinal order with protected states respected."""
    return df.groupBy(*key).agg(F.min("ord").alias("ord"), F.count("*").cast("int").alias("n_merged"),
                                *[F.expr(merged_field(f)) for f in fields])


def dedup_accounts(accounts: DataFrame, fields: list[str]) -> DataFrame:
    """Drop exact repeats, merge by (name, canonical number), drop unnumbered twins of numbered names.

    source tells accounts of a structured inventory from those found in text. Where a report has an inventory, a
    numbered account found in text counts only if the inventory has its name and number. Headings are no names,
    and a row with neither name nor number is no account.
    """
    heading = f"({norm_text('account_name')} = '' OR {norm_text('account_name')} RLIKE {rx(vocab.NOT_A_NAME)})"
    named = add(accounts, {"name_key": f"if({heading}, 'not reported', {match_text('account_name')})", "number_key": account_number_key("account_number")})
    named = named.where("name_key <> 'not reported' OR number_key <> 'not reported'")
    keyed = keep_first(named, {"k_report": "report_id", "k_name": "name_key", "k_number": "number_key",
                               **{f"k_{f}": match_text(f) for f in ("date_opened", "date_reported", "balance", "status")}})
    inventory = accounts.where("source = 'structured'").select("report_id").distinct().withColumn("has_inventory", F.lit(True))
    held = named.where("source = 'structured' AND number_key <> 'not reported'").select("report_id", "name_key", "number_key").distinct()
    numbered = keyed.where("number_key <> 'not reported'").join(inventory, "report_id", "left").join(
        held.withColumn("is_held", F.lit(True)), ["report_id", "name_key", "number_key"], "left").where("has_inventory IS NULL OR is_held")
    merged = merge_records(numbered, ["report_id", "name_key", "number_key"], fields)
    names = numbered.select("report_id", "name_key").unionByName(held.select("report_id", "name_key")).distinct()
    alone = keyed.where("number_key = 'not reported'").join(names, ["report_id", "name_key"], "left_anti")
    return merged.unionByName(alone.selectExpr(
        "report_id", "name_key", "number_key", "ord", "1 AS n_merged", *fields))


def collection_score(fields: list[str]) -> str:
    return " + ".join(f"cast(coalesce({f}, '') <> '' AS int)" for f in fields)


def dedup_collections(collections: DataFrame, expected: DataFrame, scored: list[str]) -> DataFrame:
    """Drop contaminated or thin rows, merge by identity, keep the best expected_count per report."""
    agency = norm_text("agency")
    good = collections.where(
        f"NOT coalesce(agency, '') RLIKE {rx('(?i)' + either(vocab.NOT_AN_AGENCY))} AND ({agency} = '' OR {agency} RLIKE '[A-Za-z]{{3,}}') "
        f"AND {collection_score(scored)} >= 2")
    keyed = add(good, {"agency_key": match_text("agency"),
                       "second_key": match_text("coalesce(nullif(number, ''), creditor)")})
    both = "agency_key <> '' AND second_key <> ''"
    keyed = add(keyed, {"identity": f"if({both}, concat(agency_key, '::', second_key), concat('row::', ord))"})
    firsts = [F.expr(f"coalesce(min_by({f}, if(coalesce({f}, '') <> '', ord, NULL)), '') AS {f}") for f in scored]
    merged = keyed.groupBy("report_id", "identity").agg(F.min("ord").alias("ord"), *firsts)
    merged = add(merged, {"score": collection_score(scored), "worst_first": f"-({collection_score(scored)})"})
    ranked = salted_join(grouped_rank(merged, ["report_id"], ["worst_first", "ord"]), expected, ["report_id"], "identity")
    return ranked.where("coalesce(expected_count, 0) <= 0 OR rank <= expected_count").drop(
        "worst_first", "rank", "expected_count")


def union_collections(collections: DataFrame) -> DataFrame:
    """Union dedup by agency, number, creditor, amount and status; the first ordinal stays."""
    return keep_first(collections, {f"k_{c}": match_text(c) if c != "report_id" else c for c in (
        "report_id", "agency", "number", "creditor", "amount", "status")})


#: Names of one report and day up to which they are compared inside their group; larger groups are joined on grams.
NAMES_TOGETHER = 64


def inquiry_targets(names: DataFrame, together: int = NAMES_TOGETHER) -> DataFrame:
    """report_id, day, who, primary_ord, fallback_ord: where the inquiries of a name belong.

    names: one row per (report_id, day, who) with p_ord and f_ord, its smallest primary and fallback ordinals. Two
    names match where one contains the other. primary_ord is the smallest primary of a matching name. Names without
    one keep to each other: in the order of their ordinals a name joins the first one kept that it
    matches, or is kept. Groups of few names decide this inside one row; larger ones by a gram join and rounds, in
    which names with no undecided match before them are kept and take their matches. Both give the same.
    """
    key = ["report_id", "day"]
    sizes = names.groupBy(*key).agg(F.count("*").alias("n_names"))
    match = "(contains(a.who, b.who) OR contains(b.who, a.who))"
    small = names.join(sizes.where(f"n_names <= {together}"), key).groupBy(*key).agg(F.expr("collect_list(struct(f_ord, who, p_ord)) AS g"))
    small = small.selectExpr(
        *key, f"transform(g, a -> struct(a.f_ord AS f_ord, a.who AS who, array_min(transform(filter(g, b -> {match}), b -> b.p_ord)) AS primary_ord)) AS g")
    alone = "array_sort(filter(g, x -> x.primary_ord IS NULL))"
    kept = (f"aggregate({alone}, cast(array() AS array<struct<f_ord:bigint,who:string>>), "
            f"(k, a) -> if(exists(k, b -> {match}), k, concat(k, array(struct(cast(a.f_ord AS bigint) AS f_ord, a.who AS who)))))")
    small = add(small, {"kept": kept}).selectExpr(*key, "kept", "inline(g)").selectExpr(
        *key, "who", "primary_ord", f"if(primary_ord IS NULL, element_at(filter(kept, b -> contains(who, b.who) OR contains(b.who, who)), 1).f_ord, NULL) AS fallback_ord")
    large = stored(names.join(sizes.where(f"n_names > {together}"), key).drop("n_names"), "crowded-names")
    return small if large.isEmpty() else small.unionByName(_crowded_targets(large))


def _crowded_targets(names: DataFrame) -> DataFrame:
    key = ["report_id", "day"]
    inside = contains_join(names.select(*key, "who"), names.select(*key, F.col("who").alias("other")), key, "who", "other")
    pairs = stored(inside.unionByName(inside.selectExpr(*key, "other AS who", "who AS other")).distinct(), "name-pairs")
    ords = names.selectExpr(*key, "who AS other", "p_ord AS other_p", "f_ord AS other_f")
    first = pairs.join(ords, [*key, "other"]).groupBy(*key, "who").agg(F.min("other_p").alias("primary_ord"))
    known = names.join(first, [*key, "who"])
    undecided = stored(known.where("primary_ord IS NULL").select(*key, "who", "f_ord"), "undecided")
    done = known.where("primary_ord IS NOT NULL").selectExpr(*key, "who", "cast(primary_ord AS bigint) AS primary_ord", "cast(NULL AS bigint) AS fallback_ord")
    while not undecided.isEmpty():
        near = undecided.join(pairs, [*key, "who"]).join(undecided.selectExpr(*key, "who AS other", "f_ord AS other_f"), [*key, "other"])
        kept = stored(near.groupBy(*key, "who", "f_ord").agg(F.min("other_f").alias("low")).where("low = f_ord").select(*key, "who", "f_ord"), "kept")
        taken = stored(kept.selectExpr(*key, "who AS other", "f_ord AS kept_ord").join(pairs, [*key, "other"]).join(undecided.select(*key, "who"), [*key, "who"]).groupBy(*key, "who").agg(F.min("kept_ord").alias("kept_ord")), "taken")
        done = done.unionByName(taken.selectExpr(*key, "who", "cast(NULL AS bigint) AS primary_ord", "cast(kept_ord AS bigint) AS fallback_ord"))
        undecided = stored(undecided.join(taken, [*key, "who"], "left_anti"), "undecided")
    return done


def merge_inquiries(inquiries: DataFrame) -> DataFrame:
    """Fold fallback inquiries into those of the same date whose name equals, contains or is contained.

    A fallback goes to the smallest primary ordinal that matches, else to the first fallback kept that matches. A kept row
    without a purpose gives way to its first folded row with one. pages are the distinct positive pages of a kept row
    and then of its folded ones. Rows without date or name stay as they are.
    """
    key = ["report_id", "day"]
    i = add(inquiries, {"day": match_text("inquiry_date"), "who": canonical_subscriber("subscriber")})
    names = stored(i.where("day <> '' AND who <> ''").groupBy(*key, "who").agg(
        F.expr("min(if(source = 'primary', inquiry_ord, NULL)) AS p_ord"), F.expr("min(if(source = 'fallback', inquiry_ord, NULL)) AS f_ord")), "names")
    targets = inquiry_targets(names).withColumn("to_ord", F.coalesce("primary_ord", "fallback_ord")).select(*key, "who", "to_ord")
    placed = i.join(targets, [*key, "who"], "left").selectExpr(
        "report_id", "inquiry_ord", "purpose", "pages", "if(source = 'fallback', coalesce(to_ord, inquiry_ord), inquiry_ord) AS to_ord")
    placed = add(placed, {"folded": "to_ord <> inquiry_ord"})
    spoken = f"if(folded AND {norm_text('purpose')} <> '', inquiry_ord, NULL)"
    merged = placed.groupBy("report_id", "to_ord").agg(
        F.expr("max(if(folded, NULL, purpose)) AS purpose"), F.expr(f"min({spoken}) AS better_ord"), F.expr(f"min_by(purpose, {spoken}) AS better_purpose"),
        F.count_if(F.col("folded")).alias("n_folded"))
    pages = placed.selectExpr("report_id", "to_ord", "struct(folded, inquiry_ord) AS rank", "explode(pages) AS page").where("page > 0").groupBy("report_id", "to_ord", "page").agg(F.min("rank").alias("rank"))
    pages = pages.groupBy("report_id", "to_ord").agg(F.expr("transform(array_sort(collect_list(struct(rank, page))), x -> x.page) AS pages"))
    replaced = f"{norm_text('purpose')} = '' AND better_ord IS NOT NULL"
    return merged.join(pages, ["report_id", "to_ord"], "left").selectExpr(
        "report_id", f"if({replaced}, better_ord, to_ord) AS inquiry_ord", f"if({replaced}, better_purpose, purpose) AS purpose", "n_folded",
        "coalesce(pages, cast(array() AS array<int>)) AS pages")


def best_summary_rows(candidates: DataFrame) -> DataFrame:
    """Best candidate per (report, account type): completeness less issues, then source, then ordinal."""
    return candidates.groupBy("report_id", "account_type").agg(
        F.expr("max_by(struct(*), struct(filled - issues AS s, -source_rank AS r, -ord AS o)) AS best")
    ).selectExpr("report_id", "account_type", "best.source AS source", "best.ord AS ord", "best.filled - best.issues AS score")


def filled_summary_rows(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """Best candidate per (report, account type), its empty fields filled from the others in their order.

    A field that the best candidate proves blank or explicitly not reported (<field>_state) stays as it is. Each
    field is an aggregate over the candidates' order, so no candidates are gathered.
    """
    rank = "struct(-(filled - issues) AS s, source_rank AS r, ord AS o)"

    def filled(f: str) -> str:
        own, state, other = f"min_by({f}, {rank})", f"min_by({f}_state, {rank})", f"min_by({f}, if(coalesce({f}, '') <> '', {rank}, NULL))"
        return f"if(coalesce({own}, '') <> '' OR coalesce({state} IN ('blank', 'explicit_not_reported'), false), {own}, coalesce({other}, {own})) AS {f}"

    return candidates.groupBy("report_id", "account_type").agg(F.expr(f"min_by(ord, {rank}) AS ord"), *(F.expr(filled(f)) for f in fields))


def indicators(raw: DataFrame, accounts: DataFrame, records: DataFrame) -> DataFrame:
    """Raw indicators, account-derived ones and bankruptcy public records, deduplicated on four keys."""
    a = raw.selectExpr(
        "report_id", "1 AS src", "ind_ord AS ord", f"{first_meaningful('code')} AS code",
        f"coalesce({first_meaningful('description', 'code')}, 'Consumer information indicator') AS description",
        f"{first_meaningful('linked_name')} AS linked_name", f"{first_meaningful('linked_number')} AS linked_number")
    b = accounts.where(f"NOT {is_missing('indicator')} OR context RLIKE {rx(either(vocab.BANKRUPTCY_CONTEXT))}").selectExpr(
        "report_id", "2 AS src", "ord", f"{first_meaningful('indicator')} AS code",
        f"coalesce({first_meaningful('indicator')}, 'Bankruptcy-related account condition') AS description",
        f"{first_meaningful('name')} AS linked_name", f"{first_meaningful('number')} AS linked_number")
    c = records.where(r"context RLIKE r'\bbankruptcy\b|\bchapter\s+\d+\b'").selectExpr(
        "report_id", "3 AS src", "ord", "cast(NULL AS string) AS code",
        f"coalesce({first_meaningful('record_type')}, 'Bankruptcy public record') AS description",
        "cast(NULL AS string) AS linked_name", "cast(NULL AS string) AS linked_number")
    rows = add(a.unionByName(b).unionByName(c), {"rank": "struct(src, ord)"})
    keys = {f"k_{x}": match_text(x) for x in ("code", "description", "linked_name", "linked_number")}
    return keep_first(rows, {"k_report": "report_id", **keys}, "rank").drop("rank")


def link_indicators(indicators_: DataFrame, accounts: DataFrame) -> DataFrame:
    """First account (by ordinal) whose name contains the linked name or whose number ends alike."""
    i = add(indicators_, {"linked_key": identity_key("linked_name"), "tail": number_tail("linked_number")})
    a = add(accounts, {"name_key": identity_key("name"), "tail": number_tail("number")})
    first_name = a.groupBy("report_id", "name_key").agg(F.min("ord").alias("ord"))
    by_name = contains_join(i, first_name, ["report_id"], "linked_key", "name_key").join(
        first_name, ["report_id", "name_key"]).groupBy("report_id", "linked_key").agg(F.min("ord").alias("name_ord"))
    by_tail = a.where("tail <> ''").groupBy("report_id", "tail").agg(F.min("ord").alias("tail_ord"))
    return i.join(by_name, ["report_id", "linked_key"], "left").join(by_tail, ["report_id", "tail"], "left").withColumn(
        "account_ord", F.least("name_ord", "tail_ord")).drop("linked_key", "tail", "name_ord", "tail_ord")


def match_accounts(views: DataFrame, mapped: DataFrame) -> DataFrame:
    """Mapped account per view: same entity key, most shared pages, most structured fields, first ordinal.

    Both sides are first reduced to one row per (report, entity, page list), so copies
    of an account never pair up with copies of a view.
    """
    key = ["report_id", "entity_key"]
    best = mapped.groupBy(*key, "mapped_pages").agg(F.expr(
        "max(struct(n_fields AS f, -mapped_ord AS o)) AS best"))
    pairs = views.select(*key, "pages").distinct().join(best, key)
    chosen = pairs.groupBy(*key, "pages").agg(F.expr(
        "-max(struct(size(array_intersect(pages, mapped_pages)) AS p, best.f AS f, best.o AS o)).o AS mapped_ord"))
    return views.join(chosen, [*key, "pages"]).select("report_id", "view_ord", "mapped_ord")


def lookup_accounts(wanted: DataFrame, accounts: DataFrame) -> DataFrame:
    """Evidence account: same name; same number tail when any has it; then overlap, coverage, fewer pages.

    Only distinct (name, tail, pages) classes of both sides are compared.
    """
    key = ["report_id", "name_key"]
    w = add(wanted, {"name_key": "regexp_replace(lower(name), '[^a-z0-9]', '')", "tail": solid_tail("number")})
    a = add(accounts, {"name_key": "regexp_replace(lower(account_name), '[^a-z0-9]', '')", "a_tail": solid_tail("account_number")})
    best = a.groupBy(*key, "a_tail", "a_pages").agg(F.expr("max(struct(coverage AS c, -account_ord AS o)) AS best"))
    pairs = w.select(*key, "tail", "pages").distinct().join(best, key)
    chosen = pairs.groupBy(*key, "tail", "pages").agg(F.expr(
        "-max(struct(tail <> '' AND a_tail = tail AS t, size(array_intersect(pages, a_pages)) AS p, best.c AS c, "
        "-size(a_pages) AS n, best.o AS o)).o AS account_ord"))
    return w.join(chosen, [*key, "tail", "pages"]).select("report_id", "want_ord", "account_ord")


def public_record_key() -> str:
    reference, kind, court = identity_key("reference_number"), identity_key("record_type"), identity_key("court")
    filed = match_text("date_filed")
    return (f"CASE WHEN {reference} <> '' THEN concat('reference:', {reference}) "
            f"WHEN {kind} <> '' AND {court} <> '' AND {filed} <> '' "
            f"THEN concat('type-court-filed:', {kind}, ':', {court}, ':', {filed}) ELSE '' END")


def component_pages(rows: DataFrame) -> DataFrame:
    """Distinct positive source pages per component, one row per page."""
    return rows.where("page > 0").select("report_id", "component", "page").distinct()


def with_account_counts(accounts: DataFrame) -> DataFrame:
    """Open, closed and total accounts of the report on each account; totals are aggregated, then joined."""
    totals = accounts.groupBy("report_id").agg(
        F.expr("cast(count_if(NOT is_closed) AS int) AS n_open"), F.expr("cast(count_if(is_closed) AS int) AS n_closed"),
        F.expr("cast(count(*) AS int) AS n_total"))
    return salted_join(accounts, totals, ["report_id"], "entity_key", "inner")
