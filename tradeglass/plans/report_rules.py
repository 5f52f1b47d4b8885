"""Rules over public records, consumer indicators and personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions import dates
from tradeglass.functions.text import add, contains_any, identity_key, is_missing, joined, match_text
from tradeglass.operators.linkage import link_indicators, public_record_key
from tradeglass.operators.skew import salted_join

RECORD_TEXT = joined("record_type", "court", "reference_number", "status", "amount", "date_filed", "date_resolved")


def duplicate_records(records: DataFrame) -> DataFrame:
    keyed = add(records, {"identity": public_record_key()}).where("identity <> ''")
    return keyed.groupBy("report_id", "identity").agg(F.count("*").cast("int").alias("n_records")).where("n_records > 1")


def incomplete_records(records: DataFrame) -> DataFrame:
    """Records without type, filed date, or any of court and reference, with what is missing."""
    kind, filed = is_missing("record_type"), is_missing("date_filed")
    court, reference = is_missing("court"), is_missing("reference_number")
    parts = (f"array_compact(array(if({kind}, 'record type', NULL), if({filed}, 'filed date', NULL), "
             f"CASE WHEN {court} AND {reference} THEN 'court or reference number' WHEN {court} THEN 'court' "
             f"WHEN {reference} THEN 'reference number' END))")
    return add(records, {"missing": f"array_join({parts}, ', ')"}).where(f"{kind} OR {filed} OR ({court} AND {reference})")


def obsolete_records(records: DataFrame, reports: DataFrame) -> DataFrame:
    """Filed (else resolved) at least seven years before the report date, ten for bankruptcy."""
    anchor = f"coalesce({dates.parse_date('date_filed')}, {dates.parse_date('date_resolved')})"
    limit = f"if({contains_any(RECORD_TEXT, vocab.BANKRUPTCY_WORDS)}, 120, 84)"
    dated = add(records, {"anchor_m": dates.month_index(anchor), "max_months": limit})
    report = reports.selectExpr("report_id", f"{dates.month_index(dates.parse_date('report_date'))} AS report_m")
    return salted_join(dated, report, ["report_id"], "record_ord", "inner").where("report_m - anchor_m >= max_months")


def restricted_records(records: DataFrame) -> DataFrame:
    return records.where(f"{contains_any(RECORD_TEXT, vocab.RESTRICTED_WORDS)} AND "
                         f"{contains_any(match_text('status'), vocab.ADVERSE_WORDS)}")


def incomplete_indicators(indicators: DataFrame) -> DataFrame:
    return indicators.where(f"{is_missing('description')} OR ({is_missing('linked_name')} <> {is_missing('linked_number')})")


def indicator_account_conflicts(indicators: DataFrame, accounts: DataFrame) -> DataFrame:
    """Bankruptcy-like indicators whose linked account looks current or active without bankruptcy context.

    accounts: report_id, ord, name, number, statuses and history (arrays of texts: every status field the account has, and
    its printed months), context, legal_category.
    """
    text = joined("code", "description", "category", "linked_name", "linked_number")
    linked = link_indicators(indicators.where(contains_any(text, vocab.BANKRUPTCY_WORDS)), accounts)
    state = accounts.selectExpr(
        "report_id", "ord AS account_ord", f"{contains_any(match_text("concat_ws(' ', statuses, history)"), vocab.ACTIVE_WORDS)} AS active",
        f"({contains_any(match_text('context'), vocab.BANKRUPTCY_WORDS)} OR contains({match_text('legal_category')}, 'bankruptcy')) AS bankrupt")
    return linked.join(state, ["report_id", "account_ord"]).where("active AND NOT bankrupt")


def multiple_ssns(people: DataFrame) -> DataFrame:
    """Reports with several distinct numbers; only the count and salted hashes leave this step."""
    values = "array_distinct(filter(transform(ssns, x -> trim(x)), x -> x <> ''))"
    hashes = f"array_join(array_sort(transform({values}, x -> sha2(concat(report_id, ':', x), 256))), '|')"
    return people.selectExpr("report_id", f"size({values}) AS n_values", f"{hashes} AS hashes").where("n_values > 1")


def name_mismatches(people: DataFrame, intake: DataFrame) -> DataFrame:
    both = people.join(intake, "report_id")
    mine, theirs = identity_key("full_legal_name"), identity_key("name")
    return both.where(f"{mine} <> '' AND {theirs} <> '' AND {mine} <> {theirs}").select("report_id")


def address_mismatches(people: DataFrame, intake: DataFrame) -> DataFrame:
    """No report address contains, or is contained in, the intake address."""
    line = "concat_ws(' ', nullif(line1, ''), nullif(line2, ''), concat(city, ', ', state, ' ', zip))"
    both = add(people.join(intake, "report_id"), {
        "mine": identity_key(line), "theirs": f"transform(addresses, a -> {identity_key('a')})"})
    return both.where("mine <> '' AND size(theirs) > 0 AND NOT exists(theirs, a -> contains(a, mine) OR contains(mine, a))") \
        .select("report_id")
