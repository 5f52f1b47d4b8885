"""Reading extraction payloads and conforming them to the report tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions.text import (
    add, cell_state, field_provenance_id, lit, lookup, match_text, norm_text, one_of, page_list, rx,
)
from tradeglass.operators.linkage import keep_first
from tradeglass.operators.skew import salted_join
from tradeglass.session import scratch_folder
from tradeglass.plans.account_view import ANCHOR_LAYERS, FIELD_CHAINS, field, with_anchors

ACCOUNT = ("struct<accountOrd:int,accountName:string,accountNumber:string,raw:map<string,string>,"
           "comments:array<string>,sourcePages:array<int>>")
RESULT = f"struct<reportId:string,profile:string,reportDate:string,accounts:array<{ACCOUNT}>>"
PAYLOAD = (f"struct<profile:string,fileName:string,sourceFile:string,pageImages:array<string>,version:timestamp,"
           f"result:{RESULT}>")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON payload per line, with a declared schema."""
    return parse_results(spark.read.text(path))


def parse_results(lines: DataFrame) -> DataFrame:
    """Unwrap the result object; the profile inside it wins over the envelope's."""
    parsed = lines.selectExpr(f"from_json(value, '{PAYLOAD}') AS p")
    return parsed.selectExpr("coalesce(p.result.profile, p.profile) AS profile_id", "p.fileName AS file_name",
                             "p.sourceFile AS source_file", "p.pageImages AS page_images", "p.version AS version",
                             "p.result AS result")


def latest_versions(results: DataFrame) -> DataFrame:
    """Newest usable extraction per (profile, file); usable ones keep their source file and page images."""
    usable = results.where("coalesce(source_file, '') <> '' AND size(coalesce(page_images, array())) > 0")
    return usable.groupBy("profile_id", "file_name").agg(F.expr("max_by(struct(*), version) AS r")).select("r.*")


def tradelines(results: DataFrame) -> DataFrame:
    """Account rows of the payloads; raw stays a map because absent and empty differ."""
    key = f"concat({match_text('a.accountName')}, '::', {norm_text('a.accountNumber')})"
    return results.selectExpr("profile_id", "result.reportId AS report_id", "result.reportDate AS report_date",
                              "explode(result.accounts) AS a").selectExpr(
        "report_id", "profile_id", "report_date", "a.accountOrd AS account_ord", "a.accountName AS account_name",
        "a.accountNumber AS account_number", f"{key} AS entity_key", "a.raw AS raw", "a.comments AS comments",
        "a.sourcePages AS source_pages")


def split_pages(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Report text to pages on form feeds."""
    return texts.selectExpr(*key, f"posexplode(split({text}, {rx('\\f')})) AS (pos, page_text)").selectExpr(
        *key, "pos + 1 AS page", "page_text")


PLAIN_FIELDS = [n for n, chains in FIELD_CHAINS.items()
                if not any(e[0] in "@=" or ":" in e for c in chains.values() for e in c)]


def conform(accounts: DataFrame) -> DataFrame:
    """The four layouts to one model: per-layout key chains resolve the same columns, in one pass."""
    names = [n for n in PLAIN_FIELDS if n not in ANCHOR_LAYERS[1]]
    return add(with_anchors(accounts, {"raw_text", "name", "number", *ANCHOR_LAYERS[1]}), {n: field(n) for n in names}).select(
        "report_id", "profile_id", "account_ord", "entity_key", "name", "number", *PLAIN_FIELDS)


def attach_sources(accounts: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages (and printed years) of an account by identity key, else the pages of its section."""
    s = sources.groupBy("report_id", "entity_key").agg(
        F.expr("max_by(pages, ord) AS pages"), F.expr("max_by(years, if(size(years) > 0, ord, NULL)) AS years"))
    joined = salted_join(accounts.join(s, ["report_id", "entity_key"], "left"), sections, ["report_id"], "entity_key")
    return joined.selectExpr("report_id", "entity_key", "coalesce(pages, section_pages) AS source_pages", "years")


def section_pages(windows: DataFrame) -> DataFrame:
    """Component to its distinct positive pages; components without any are left out."""
    return windows.selectExpr("report_id", "component", f"{page_list('pages')} AS pages").where("size(pages) > 0")


def write_by_layout(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write findings, outcomes or reports, one folder per layout."""
    df.write.mode("overwrite").partitionBy("profile_id").format(fmt).save(path)


def written(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back with its declared schema."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    write_by_layout(df, path, fmt)
    return spark.read.schema(df.schema).format(fmt).load(path)


def flatten_scalars(accounts: DataFrame) -> DataFrame:
    """(path, component, value) of every raw scalar worth grounding on a page.

    Placeholders and numbers of at most three digits are left out; those are checked
    by counts instead.
    """
    value = norm_text("value")
    short = f"({value} RLIKE {rx(r'^[\d,\.%$]+$')} AND length(regexp_replace({value}, '[^0-9]', '')) <= 3)"
    return accounts.selectExpr("report_id", "account_ord", "explode(raw) AS (key, value)").where(
        f"NOT {one_of(match_text('value'), vocab.PLACEHOLDERS)} AND NOT {short}").selectExpr(
        "report_id", "concat('accounts[', account_ord, '].', key) AS path", "'accounts' AS component", "value")


def collections_from_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts whose reporting category is collection, as collection rows."""
    return accounts.where(f"{match_text("raw['reportingCategory']")} = 'collection'").selectExpr(
        "report_id", "account_ord AS ord", "account_name AS agency", "account_number AS number",
        "coalesce(raw['originalCreditorName'], raw['accountInfo.originalCreditor'], '') AS creditor")


RECORD_LABELS = {"type": "record_type", "record type": "record_type", "court": "court", "reference number": "reference_number",
                 "case number": "reference_number", "date filed": "date_filed", "status": "status"}


def public_records(records: DataFrame) -> DataFrame:
    """Label: value detail lines to fields; a trailing identifier of the type is split off; the rest stays as details."""
    line = records.selectExpr("report_id", "record_ord", "posexplode(details) AS (pos, line)")
    label = f"if(contains(line, ':'), {lookup(match_text("substring_index(line, ':', 1)"), RECORD_LABELS)}, NULL)"
    parts = add(line, {"field": label, "value": "trim(substring(line, instr(line, ':') + 1))"})
    names = sorted(set(RECORD_LABELS.values()))
    out = parts.groupBy("report_id", "record_ord").agg(
        *[F.expr(f"coalesce(min_by(value, if(field = '{n}', pos, NULL)), '') AS {n}") for n in names],
        F.expr("array_join(transform(array_sort(collect_list(if(field IS NULL, struct(pos, line), NULL))), x -> x.line), ' | ') AS details"))
    tail = rx(r"^(.*?)\s+([A-Z0-9-]*\d{4,}[A-Z0-9-]*)$")
    return out.selectExpr(
        "report_id", "record_ord", f"if(record_type RLIKE {tail}, regexp_extract(record_type, {tail}, 1), record_type) AS record_type",
        f"coalesce(nullif(reference_number, ''), regexp_extract(record_type, {tail}, 2)) AS reference_number",
        "court", "date_filed", "status", "details")


def provenance(accounts: DataFrame) -> DataFrame:
    """One provenance row per raw account field: name, number, field, first page, id."""
    return accounts.selectExpr("report_id", "account_name", "account_number", "source_pages[0] AS page",
                               "explode(raw) AS (field, value)").selectExpr(
        "report_id", "account_name", "account_number", "field", "page",
        f"{field_provenance_id('account_name', 'account_number', 'field')} AS provenance_id")


def normalize_contract(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Exactly five summary rows per report in fixed order; absent ones are 'Not reported'."""
    types = ", ".join(lit(t) for t in vocab.SUMMARY_TYPES)
    spine = reports.selectExpr("report_id", f"posexplode(array({types})) AS (pos, account_type)")
    first = keep_first(rows, {"k_report": "report_id", "k_type": "account_type"})
    return spine.join(first, ["report_id", "account_type"], "left").selectExpr(
        "report_id", "pos + 1 AS row_no", "account_type", "coalesce(nullif(trim(total_accounts), ''), 'Not reported') AS total_accounts")


def pairs_from_table(rows: DataFrame, key: list[str]) -> DataFrame:
    """Label/value cells of a printed row: a known label takes the next non-empty cell that is not a label."""
    def label(c: str) -> str:
        return lookup(f"trim(TRAILING ':' FROM {match_text(c)})", vocab.PAIR_LABELS)

    cells = f"filter(transform(cells, c -> {norm_text('c')}), c -> c <> '')"
    tagged = f"transform({cells}, c -> struct(c AS text, {label('c')} AS field))"
    pairs = "filter(transform(t, (x, i) -> struct(x.field AS field, if(get(t, i + 1).field IS NULL, coalesce(get(t, i + 1).text, ''), '') AS value)), x -> x.field IS NOT NULL)"
    out = rows.selectExpr(*key, f"{tagged} AS t").selectExpr(*key, f"inline({pairs})")
    return out.selectExpr(*key, "field", "value", f"{cell_state('value')} AS state")
