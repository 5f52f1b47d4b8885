"""Queries of validation, page and box operators, and incremental data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.catalog.binding import VIEWS
from tradeglass.catalog.functions import LETTERS
from tradeglass.catalog.registry import ORACLE_VIEWS, query
from tradeglass.operators import grounding
from tradeglass.operators import layout as l
from tradeglass.operators import quality as q
from tradeglass.operators import regression
from tradeglass.streaming import incremental as t

COMPONENTS = ["reportConfirmationDetails", "personalInformation", "summary", "creditAccountsSummary", "otherItemsSummary", "accounts", "collections", "inquiries",
              "reportOverview", "publicRecords", "hardInquiries", "softInquiries", "adverseAccounts", "satisfactoryAccounts", "accountReviewInquiries"]
VIEWS["fx_component"] = "SELECT r.report_id, r.profile_id, t.component FROM fx_report r CROSS JOIN (VALUES " + ", ".join(
    f"('{c}')" for c in COMPONENTS) + ") AS t(component)"
VIEWS["fx_issue"] = """
    SELECT report_id, CASE k % 5 WHEN 0 THEN 'accounts' WHEN 1 THEN 'collections' WHEN 2 THEN 'adverseAccounts' WHEN 3 THEN 'softInquiries' ELSE 'creditAccountsSummary' END AS component,
           CASE WHEN k % 131 = 0 THEN 'error' WHEN k % 137 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM fx_account"""
VIEWS["fx_stated"] = """
    SELECT report_id, 'accounts' AS component, CAST(CASE WHEN lay = 0 THEN n ELSE n + 1 END AS int) AS stated, CAST(CASE WHEN lay = 3 THEN n + 1 ELSE n - 2 END AS int) AS n_open,
           CAST(CASE WHEN lay = 1 THEN 2 END AS int) AS n_closed FROM (SELECT report_id, lay, count(*) AS n FROM fx_account GROUP BY report_id, lay) x
    UNION ALL SELECT report_id, 'inquiries', CAST(CASE WHEN report_id = '3' THEN 0 ELSE n - CAST(report_id AS int) % 2 END AS int), NULL, NULL
    FROM (SELECT report_id, count(*) AS n FROM fx_inquiry GROUP BY report_id) y"""
VIEWS["fx_extracted"] = """SELECT report_id, 'accounts' AS component, count(*) AS extracted FROM fx_account GROUP BY report_id
    UNION ALL SELECT report_id, 'inquiries', count(*) FROM fx_inquiry GROUP BY report_id"""
CHECKS_SQL = """SELECT report_id, component, stated, CAST(extracted AS int) AS extracted, CASE WHEN stated > 0 AND (component = 'inquiries' OR n_closed IS NOT NULL
    OR (n_open IS NOT NULL AND stated <> n_open)) THEN stated = extracted ELSE true END AS pass FROM fx_stated JOIN fx_extracted USING (report_id, component)"""
ORACLE_VIEWS["ora_check"] = CHECKS_SQL
ORACLE_VIEWS["ora_status"] = """SELECT report_id, profile_id, component, CASE WHEN EXISTS (SELECT 1 FROM fx_issue i WHERE i.report_id = c.report_id
    AND i.component = c.component AND i.severity <> 'warning') THEN 'failed' ELSE 'complete' END AS status FROM fx_component c"""
FIELD_CHECKS = {"missing_status": ("accounts", "error", "coalesce(status, '') = ''"), "missing_balance": ("accounts", "warning", "coalesce(balance, '') = ''"),
                "missing_open_date": ("accounts", "error", "opened IS NULL")}


@query("v1_required_fields", " UNION ALL ".join(
    f"SELECT report_id, k, '{c}' AS component, '{s}' AS severity, '{code}' AS code FROM fx_account WHERE {test}" for code, (c, s, test) in FIELD_CHECKS.items()))
def v1(b):
    return q.field_issues(b.view("fx_account"), ["report_id", "k"], FIELD_CHECKS)


def checks(b):
    return q.count_mismatches(b.view("fx_stated"), b.view("fx_extracted"))


@query("v2_cross_component_counts", "SELECT report_id, component, stated, extracted FROM ora_check WHERE NOT pass")
def v2(b):
    return checks(b).where("NOT pass").drop("pass")


def statuses(b):
    return q.component_status(b.view("fx_component"), b.view("fx_issue"))


@query("v3_component_status", "SELECT report_id, profile_id, component, status FROM ora_status")
def v3(b):
    return statuses(b)


# which layouts need a component, written out once more and not taken from the operator
ORACLE_VIEWS["ora_need"] = """SELECT * FROM (VALUES ('reportConfirmationDetails', 'OLD NEW'), ('personalInformation', 'OLD NEW EXP TRU'), ('summary', 'OLD NEW'), ('creditAccountsSummary', 'OLD'), ('otherItemsSummary', 'OLD'),
    ('accounts', 'OLD NEW EXP'), ('collections', 'OLD'), ('inquiries', 'OLD NEW TRU'), ('reportOverview', 'EXP TRU'), ('publicRecords', 'EXP'), ('hardInquiries', 'EXP'), ('softInquiries', 'EXP'),
    ('adverseAccounts', 'TRU'), ('satisfactoryAccounts', 'TRU'), ('accountReviewInquiries', 'TRU')) AS t(component, needed_by)"""


@query("v4_readiness", """SELECT report_id, profile_id, CAST(bool_and(status = 'complete' OR NOT contains(needed_by, CASE profile_id WHEN 'equifax_old_v1' THEN 'OLD' WHEN 'equifax_new_v1' THEN 'NEW'
    WHEN 'experian_acr_v1' THEN 'EXP' ELSE 'TRU' END)) AS int) AS ready FROM ora_status JOIN ora_need USING (component) GROUP BY report_id, profile_id""")
def v4(b):
    return q.readiness(statuses(b)).selectExpr("report_id", "profile_id", "cast(ready AS int) AS ready")


PAGES = {"spark": "SELECT doc_id, page, array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), ' ') AS page_text FROM fx_line GROUP BY doc_id, page",
         "duck": "SELECT doc_id, page, string_agg(line, ' ' ORDER BY line_no) AS page_text FROM fx_line GROUP BY doc_id, page"}
ORACLE_VIEWS["ora_page"] = PAGES["duck"]
VALUES = """SELECT doc_id AS report_id, CAST(doc_id AS string) || ':' || CAST(line_no AS string) AS path, CASE line_no % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'edited' ELSE 'foreign' END AS component,
    CASE line_no % 3 WHEN 0 THEN line WHEN 1 THEN 'zq9 ' || line ELSE line || ' zq8 zq7' END AS value FROM fx_line WHERE line <> ''"""
NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
TOKENS = "list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda x: length(x) >= 2)"
SPELL = (f"list_distinct(list_filter([{NORM.format('value')}, {PLAIN.format('value')}, CASE WHEN contains(value, '$') THEN {NORM.format("replace(replace(value, '$', ''), ',', '')")} "
         f"ELSE '' END, {NORM.format("replace(value, ',', '')")}], lambda x: length(x) >= 4))")
ORACLE_VIEWS["ora_ground"] = f"""
    SELECT f.report_id, f.path, f.component, CAST(count(DISTINCT p.page) FILTER (WHERE len(list_filter(f.sp, lambda s: contains(p.norm, s) OR contains(p.plain, s))) > 0
        OR (len(f.tk) > 0 AND (len(list_filter(f.tk, lambda x: NOT list_contains(p.tk, x))) = 0 OR (len(f.tk) >= 4 AND len(list_filter(f.tk, lambda x: NOT list_contains(p.tk, x))) = 1)))) AS int) AS n_pages
    FROM (SELECT *, {SPELL} AS sp, {TOKENS.format(NORM.format('value'))} AS tk FROM ({VALUES}) v) f
    JOIN (SELECT doc_id, page, {NORM.format('page_text')} AS norm, {PLAIN.format('page_text')} AS plain, {TOKENS.format(NORM.format('page_text'))} AS tk FROM ora_page) p ON p.doc_id = f.report_id
    GROUP BY f.report_id, f.path, f.component"""


def printed_pages(b):
    return b.sql(PAGES["spark"])


def grounded(b):
    return grounding.grounded_fields(b.sql(VALUES), printed_pages(b).withColumnRenamed("doc_id", "report_id"))


@query("v5_value_grounding", "SELECT report_id, path, n_pages FROM ora_ground")
def v5(b):
    return grounded(b).selectExpr("cast(report_id AS bigint) AS report_id", "path", "n_pages")


@query("v6_match_rate", """SELECT component, CAST(count(*) AS int) AS total, CAST(count(*) FILTER (WHERE n_pages > 0) AS int) AS matched,
    round(avg(CASE WHEN n_pages > 0 THEN 1.0 ELSE 0.0 END), 4) AS match_rate FROM ora_ground GROUP BY ROLLUP (component)""")
def v6(b):
    return q.match_rates(grounded(b))


@query("v7_count_checks", "SELECT report_id, component, CAST(pass AS int) AS pass FROM ora_check")
def v7(b):
    return checks(b).selectExpr("report_id", "component", "cast(pass AS int) AS pass")


CONTACT = """SELECT report_id, 'missing_contact_information' AS code, CASE WHEN n = m THEN 'critical' ELSE 'warning' END AS severity, CAST(m AS int) AS n_missing FROM (
    SELECT report_id, count(*) AS n, count(*) FILTER (WHERE address IS NULL AND phone = '') AS m FROM fx_account GROUP BY report_id) x WHERE m > 0"""


@query("v8_contact_quality", CONTACT)
def v8(b):
    return q.contact_issues(b.view("fx_account"))


EXPECTED = "SELECT report_id, kind, CAST(count(*) AS int) + CASE kind WHEN 'hard' THEN 0 ELSE CAST(report_id AS int) % 2 END AS expected FROM fx_inquiry GROUP BY report_id, kind"
ACTUAL = "SELECT report_id, kind, CAST(count(*) AS int) AS actual FROM fx_inquiry GROUP BY report_id, kind"


@query("v9_verified_ready", f"""SELECT report_id, CAST(NOT EXISTS (SELECT 1 FROM ora_status s JOIN ora_need n USING (component) WHERE s.report_id = r.report_id AND s.status = 'failed' AND contains(n.needed_by, CASE r.profile_id WHEN 'equifax_new_v1' THEN 'NEW' ELSE 'OLD' END))
    AND NOT EXISTS (SELECT 1 FROM ora_check c WHERE c.report_id = r.report_id AND NOT c.pass)
    AND NOT EXISTS (SELECT 1 FROM ({EXPECTED}) e JOIN ({ACTUAL}) a USING (report_id, kind) WHERE e.report_id = r.report_id AND e.expected <> a.actual)
    AND NOT EXISTS (SELECT 1 FROM ({CONTACT}) i WHERE i.report_id = r.report_id AND i.severity = 'critical') AS int) AS verified FROM fx_report r""")
def v9(b):
    fixtures = q.fixture_checks(b.sql(EXPECTED), b.sql(ACTUAL), ["report_id", "kind"])
    return q.verified_ready(b.view("fx_report"), statuses(b), checks(b), q.contact_issues(b.view("fx_account")), fixtures).selectExpr(
        "report_id", "cast(verified AS int) AS verified")


@query("v10_fixture_checks", f"SELECT report_id, kind, expected, actual, CAST(expected = actual AS int) AS pass FROM ({EXPECTED}) e JOIN ({ACTUAL}) a USING (report_id, kind)")
def v10(b):
    return q.fixture_checks(b.sql(EXPECTED), b.sql(ACTUAL), ["report_id", "kind"]).selectExpr(
        "report_id", "kind", "expected", "actual", "cast(pass AS int) AS pass")


# four shapes of fixtures: counts, pages, fields and month cells; the expectation has planted differences of each
SHAPES = """
    SELECT 'count' AS shape, report_id, CAST(NULL AS string) AS entity_key, kind AS cell, CAST(count(*) AS string) AS value FROM fx_inquiry GROUP BY report_id, kind
    UNION ALL SELECT DISTINCT 'page', report_id, kind, CAST(page AS string), 'yes' FROM fx_inquiry
    UNION ALL SELECT 'field', report_id, entity_key, 'status', status FROM fx_account UNION ALL SELECT 'field', report_id, entity_key, 'balance', balance FROM fx_account
    UNION ALL SELECT 'month', report_id, entity_key, CAST(m AS string), status FROM fx_hist"""
PLANTED = f"""SELECT shape, report_id, entity_key, CASE WHEN shape = 'page' AND report_id = '7' THEN '9' || cell ELSE cell END AS cell,
    CASE WHEN shape = 'count' AND report_id = '3' THEN '0' WHEN shape = 'field' AND report_id IN ('5', '6') AND entity_key LIKE '%1' THEN 'Moved' WHEN shape = 'month' AND report_id = '4' AND cell LIKE '%77' AND value = 'OK' THEN '30'
         WHEN shape = 'field' AND report_id = '8' AND cell = 'balance' THEN NULL ELSE value END AS value FROM ({SHAPES}) s WHERE NOT (shape = 'month' AND report_id = '9' AND cell LIKE '%5')"""


@query("v10_fixture_differences", f"""SELECT coalesce(e.shape, a.shape) AS shape, coalesce(e.report_id, a.report_id) AS report_id, coalesce(e.entity_key, a.entity_key) AS entity_key, coalesce(e.cell, a.cell) AS cell,
    e.value AS expected, a.value AS actual, CASE WHEN e.shape IS NULL THEN 'unexpected' WHEN a.shape IS NULL THEN 'missing' ELSE 'changed' END AS kind
    FROM ({PLANTED}) e FULL JOIN ({SHAPES}) a ON a.shape = e.shape AND a.report_id = e.report_id AND a.entity_key IS NOT DISTINCT FROM e.entity_key AND a.cell = e.cell
    WHERE e.shape IS NULL OR a.shape IS NULL OR e.value IS DISTINCT FROM a.value""")
def v10_differences(b):
    return regression.differences(b.sql(PLANTED), b.sql(SHAPES))


AUDIT = ("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'equifax_old_v1' WHEN 1 THEN 'experian_acr_v1' WHEN 2 THEN 'equifax_new_v1' ELSE 'transunion_acr_v1' END AS profile_id, "
         "text || CASE doc_id % 3 WHEN 0 THEN ' Other Accounts; apartment lease' WHEN 1 THEN ' bankruptcy and credit report messages' ELSE ' soft inquiries' END AS body FROM documents")
SECTION_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, profile_id, '{s}' AS section FROM ({AUDIT}) a WHERE regexp_matches(body, '(?i{'m' if p[0].startswith('^') else ''}){'|'.join(p)}')"
    for s, p in vocab.SECTION_PATTERNS.items())
COVERED = ", ".join(f"('{p}', '{s}')" for p, sections in vocab.LAYOUT_COVERAGE.items() for s in sections)


@query("v11_section_gaps", f"""SELECT profile_id, section, CAST(count(*) AS int) AS n_documents FROM ({SECTION_ROWS}) x
    WHERE NOT EXISTS (SELECT 1 FROM (VALUES {COVERED}) c(p, s) WHERE c.p = x.profile_id AND c.s = x.section) GROUP BY profile_id, section""")
def v11(b):
    return q.section_gaps(b.sql(AUDIT)).groupBy("profile_id", "section").agg(F.count("*").cast("int").alias("n_documents"))


@query("v12_layout_summary", """SELECT report_id, profile_id, CAST(count(*) AS int) AS n_accounts, CAST(count(*) FILTER (WHERE type_text = 'Mortgage') AS int) AS n_mortgage,
    CAST((SELECT count(*) FROM fx_issue i WHERE i.report_id = a.report_id) AS int) AS n_issues FROM fx_account a GROUP BY report_id, profile_id""")
def v12(b):
    return q.layout_summary(b.view("fx_account").withColumnRenamed("type_text", "type"), b.view("fx_issue"))


VIEWS["fx_box"] = """
    SELECT doc_id, page, line_no, word_no, CAST(doc_id % 50 AS bigint) AS finding_no, CAST(doc_id AS string) || ':' || CAST(page AS string) AS finding_id,
           line_no * 100000 + word_no AS box_no, CAST(word_no % 9 * 60 AS double) AS x, CAST(line_no % 12 * 40 AS double) AS y, CAST(length(word) * 6 AS double) AS width,
           CAST(12 AS double) AS height, CASE word_no % 7 WHEN 0 THEN 'identity' ELSE 'evidence' END AS kind,
           CASE word_no % 11 WHEN 0 THEN 'ocr' WHEN 1 THEN 'pdf' ELSE 'layout' END AS source, token FROM fx_word"""
CITED = "SELECT finding_id, token AS item FROM fx_box UNION ALL SELECT CAST(doc_id AS string) || ':1', 'cited only' FROM documents"
MEASURED = "SELECT finding_id, doc_id, page, token AS item, x, y, width, height, x / 2 + CASE WHEN word_no % 13 = 0 THEN 2 ELSE 0 END AS point_x, y / 2 AS point_y FROM fx_box"
SIZES = "SELECT doc_id, page, CAST(540 AS double) AS page_width, CAST(480 AS double) AS page_height FROM fx_box GROUP BY doc_id, page"


@query("v13_evidence_coverage", f"""SELECT finding_id, CAST(coalesce(n_uncovered, 0) AS int) AS n_uncovered, CAST(coalesce(n_duplicate_rects, 0) AS int) AS n_duplicate_rects,
    CAST(coalesce(n_off_page, 0) AS int) AS n_off_page, CAST(coalesce(n_geometry, 0) AS int) AS n_geometry FROM (SELECT finding_id, count(*) FILTER (WHERE item = 'cited only') AS n_uncovered FROM ({CITED}) c GROUP BY 1) a
    FULL JOIN (SELECT finding_id, count(*) AS n_duplicate_rects FROM (SELECT finding_id FROM fx_box GROUP BY finding_id, page, x, y, width, height HAVING count(*) > 1) z GROUP BY 1) d USING (finding_id)
    FULL JOIN (SELECT finding_id, count(*) FILTER (WHERE x + width > 540 OR y + height > 480) AS n_off_page, count(*) FILTER (WHERE word_no % 13 = 0) AS n_geometry FROM fx_box GROUP BY 1) g USING (finding_id)""")
def v13(b):
    return q.evidence_coverage(b.sql(CITED), b.sql(MEASURED), b.sql(SIZES))


BUNDLES = ("SELECT report_id, profile_id, entity_key AS finding_id, CASE k % 3 WHEN 0 THEN 'quality' ELSE 'legacy' END AS mode, "
           "CASE WHEN k % 5 = 0 THEN 'unresolved' ELSE 'ready' END AS status, k % 3 = 0 AS export_grade, lay = 1 AS canonical FROM fx_account")


@query("v14_certification", f"""SELECT profile_id, CAST(count(*) AS int) AS n_findings, CAST(count(*) FILTER (WHERE status = 'ready' AND mode = 'quality') AS int) AS n_exportable,
    CAST(count(*) FILTER (WHERE status <> 'ready') AS int) AS n_unresolved, 'legacy=' || count(*) FILTER (WHERE mode = 'legacy') || ',quality=' || count(*) FILTER (WHERE mode = 'quality') AS modes,
    CAST(count(DISTINCT report_id) AS int) AS n_reports FROM ({BUNDLES}) x GROUP BY profile_id""")
def v14(b):
    return q.certification(b.sql(BUNDLES)).withColumn(
        "modes", F.expr("array_join(transform(map_entries(modes), e -> concat(e.key, '=', e.value)), ',')"))


LABELLED = """SELECT entity_key AS finding_id, CASE k % 3 WHEN 0 THEN 'payment_history_missing_months' WHEN 1 THEN 'delinquency_progression_inconsistency' ELSE 'missing_account_number' END AS issue_type,
    CAST(k % 2 AS int) AS slide, CASE k % 4 WHEN 0 THEN 'Missing payment-history month' WHEN 1 THEN 'Later delinquency month' ELSE 'Other' END AS label, CAST(k % 10 / 20.0 AS double) AS crop_share, k FROM fx_account"""


@query("v15_structural_problems", f"""
    SELECT finding_id, 'missing_slot_proof_not_shown' AS problem FROM ({LABELLED}) x WHERE k % 3 = 0 AND k % 4 <> 0
    UNION ALL SELECT finding_id, 'gap_boundary_not_shown' FROM ({LABELLED}) x WHERE k % 3 = 0
    UNION ALL SELECT finding_id, 'earlier_delinquency_month_not_shown' FROM ({LABELLED}) x WHERE k % 3 = 1
    UNION ALL SELECT finding_id, 'later_delinquency_month_not_shown' FROM ({LABELLED}) x WHERE k % 3 = 1 AND k % 4 <> 1
    UNION ALL SELECT finding_id, 'oversized_crop' FROM ({LABELLED}) x WHERE k % 3 < 2 AND crop_share > 0.28""")
def v15(b):
    return q.structural_problems(b.sql(LABELLED))


# --- words and boxes ----------------------------------------------------------------------

WORDS = ("SELECT doc_id, page, line_no, word_no, word, CAST(word_no * 40 AS double) AS x, CAST(line_no * 12 + word_no % 2 AS double) AS y, "
         "CAST(length(word) * 5 AS double) AS width, CAST(10 AS double) AS height, token FROM fx_word")


@query("l1_text_rows", """SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS int) AS row_no, n AS n_words, body FROM (
    SELECT doc_id, page, line_no, CAST(count(*) AS int) AS n, md5(string_agg(word, ' ' ORDER BY word_no)) AS body FROM fx_word GROUP BY doc_id, page, line_no) x""")
def l1(b):
    return l.text_rows(b.sql(WORDS)).selectExpr("doc_id", "page", "row_no", "n_words", "md5(text) AS body")


BLOCKS = "SELECT doc_id, page, line_no, word_no, CAST(word_no % 5 * 50 + line_no % 3 * 4 AS double) AS x FROM fx_word"
COLUMNS_SQL = f"""SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY c) AS int) AS col_no, col_x FROM (
    SELECT doc_id, page, CAST(floor(x / 50) AS int) AS c, avg(x) AS col_x FROM ({BLOCKS}) b GROUP BY doc_id, page, CAST(floor(x / 50) AS int)) z"""


@query("l2_columns", f"SELECT doc_id, page, col_no, round(col_x, 6) AS col_x FROM ({COLUMNS_SQL}) y")
def l2(b):
    return l.columns(b.sql(BLOCKS)).selectExpr("doc_id", "page", "col_no", "round(col_x, 6) AS col_x")


@query("l3_nearest_column", f"""SELECT doc_id, page, line_no, word_no, col_no FROM (SELECT b.*, c.col_no, row_number() OVER (PARTITION BY b.doc_id, b.page, b.line_no, b.word_no
    ORDER BY abs(c.col_x - b.x), c.col_no) AS rn FROM ({BLOCKS}) b JOIN ({COLUMNS_SQL}) c USING (doc_id, page)) z WHERE rn = 1""")
def l3(b):
    blocks = b.sql(BLOCKS)
    return l.nearest_column(blocks, l.columns(blocks)).select("doc_id", "page", "line_no", "word_no", "col_no")


TABLES = """SELECT k, CASE k % 3 WHEN 0 THEN 'Year,Jan,Feb,Mar,Apr,May' WHEN 1 THEN 'Label,Value' ELSE 'Year,Jan,Feb,Total,Sum' END AS h, CAST(k % 5 AS int) AS n_columns,
    CAST(k % 4 AS int) AS n_rows FROM fx_account"""


@query("l4_table_kind", f"""SELECT k, kind, CASE WHEN n_rows <= 1 AND kind <> 'keyValue' THEN CASE WHEN n_columns <= 1 THEN 'short_table,insufficient_columns' ELSE 'short_table' END
    WHEN n_columns <= 1 THEN 'insufficient_columns' ELSE '' END AS concerns FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 'grid' WHEN n_columns IN (2, 4) THEN 'keyValue' ELSE 'table' END AS kind FROM ({TABLES}) x) y""")
def l4(b):
    return l.table_kind(b.sql(TABLES).selectExpr("k", "split(h, ',') AS header", "n_columns", "n_rows")).select("k", "kind", "concerns")


# anchors: the distinct first three words of the lines of a document, named by their first line, sought on every page
ANCHORS = {"spark": "SELECT doc_id, CAST(min(line_no) AS string) AS anchor_id, phrase FROM (SELECT doc_id, line_no, array_join(transform(array_sort(collect_list(struct(word_no, token))), x -> x.token), ' ') AS phrase FROM fx_word WHERE word_no BETWEEN 1 AND 3 GROUP BY doc_id, line_no) p GROUP BY doc_id, phrase",
           "duck": "SELECT doc_id, CAST(min(line_no) AS string) AS anchor_id, phrase FROM (SELECT doc_id, line_no, string_agg(token, ' ' ORDER BY word_no) AS phrase FROM fx_word WHERE word_no BETWEEN 1 AND 3 GROUP BY doc_id, line_no) p GROUP BY doc_id, phrase"}


def anchors(b):
    return b.sql(ANCHORS["spark"]).selectExpr("doc_id", "anchor_id", "split(phrase, ' ') AS tokens")


ORACLE_VIEWS["ora_seq"] = f"""SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, word_no) AS pos FROM ({WORDS}) w"""
ORACLE_VIEWS["ora_gram"] = """
    SELECT a.doc_id, a.page, a.pos, a.line_no, a.token || coalesce(' ' || b.token, '') || coalesce(' ' || c.token, '') AS phrase, 1 + (b.token IS NOT NULL)::int + (c.token IS NOT NULL)::int AS n,
           least(a.x, coalesce(b.x, a.x), coalesce(c.x, a.x)) AS x, least(a.y, coalesce(b.y, a.y), coalesce(c.y, a.y)) AS y,
           greatest(a.x + a.width, coalesce(b.x + b.width, 0), coalesce(c.x + c.width, 0)) AS x2
    FROM ora_seq a LEFT JOIN ora_seq b ON b.doc_id = a.doc_id AND b.page = a.page AND b.pos = a.pos + 1 AND {n} >= 2
    LEFT JOIN ora_seq c ON c.doc_id = a.doc_id AND c.page = a.page AND c.pos = a.pos + 2 AND {n} >= 3"""
_grams = " UNION ALL ".join(f"SELECT * FROM ({ORACLE_VIEWS['ora_gram'].format(n=n)}) g{n} WHERE n = {n}" for n in (1, 2, 3))
ORACLE_VIEWS["ora_gram"] = _grams
ORACLE_VIEWS["ora_anchor"] = f"SELECT *, len(string_split(phrase, ' ')) AS n, regexp_replace(phrase, '[^a-z0-9]', '', 'g') AS compact FROM ({ANCHORS['duck']}) z"
ORACLE_VIEWS["ora_match"] = """SELECT doc_id, page, anchor_id, line_no, x, y, width, row_number() OVER (PARTITION BY doc_id, page, anchor_id ORDER BY line_no, x, y, width) AS position FROM (
    SELECT doc_id, page, anchor_id, x, y, width, min(line_no) AS line_no FROM (
      SELECT g.doc_id, g.page, a.anchor_id, g.line_no, g.x, g.y, g.x2 - g.x AS width FROM ora_anchor a JOIN ora_gram g ON g.doc_id = a.doc_id AND g.n = a.n AND g.phrase = a.phrase
      UNION ALL SELECT w.doc_id, w.page, a.anchor_id, w.line_no, w.x, w.y, w.width FROM ora_anchor a JOIN ora_seq w ON w.doc_id = a.doc_id AND a.n > 1
                AND regexp_replace(w.token, '[^a-z0-9]', '', 'g') = a.compact) u GROUP BY ALL) v"""


@query("l5_phrase_search", "SELECT doc_id, page, anchor_id, x, y, width, position FROM ora_match")
def l5(b):
    return l.phrase_matches(b.sql(WORDS), anchors(b)).select("doc_id", "page", "anchor_id", "x", "y", "width", "position")


@query("l6_box_clusters")
def l6(b):
    found = l.phrase_matches(b.sql(WORDS), anchors(b))
    boxes = found.selectExpr("*", "struct(doc_id, page, anchor_id, line_no, x, y) AS box_id", "1.0D AS weight", "0.99D AS confidence", "'evidence' AS kind")
    return l.ranked_clusters(l.box_clusters(boxes, 36.0, 26.0)).selectExpr("doc_id", "page", "round(score, 6) AS score", "position")


@query("l7_distinct_highlights", """SELECT doc_id, page, min(box_no) AS box_id FROM fx_box WHERE kind <> 'identity'
    GROUP BY doc_id, page, round(x / 1.5), round(y / 1.5), round(width / 1.5), round(height / 1.5)""")
def l7(b):
    return l.distinct_highlights(b.view("fx_box").withColumnRenamed("box_no", "box_id"))


SLIDES = "SELECT doc_id AS finding_id, page, line_no AS slide_no, CASE line_no % 2 WHEN 0 THEN 'a' ELSE 'b' END AS label, CAST(length(line) AS string) AS rects FROM fx_line"


@query("l8_distinct_slides", f"SELECT finding_id, page, label, rects, min(slide_no) AS slide_no FROM ({SLIDES}) x GROUP BY ALL")
def l8(b):
    return l.distinct_slides(b.sql(SLIDES))


@query("l9_export_grade", "SELECT finding_id, CAST(bool_and(word_no % 17 <> 0 AND source IN ('layout', 'pdf')) AS int) AS export_grade FROM fx_box GROUP BY finding_id")
def l9(b):
    return l.export_grade(b.view("fx_box").selectExpr("*", "word_no % 17 <> 0 AS has_points")).selectExpr("finding_id", "cast(export_grade AS int) AS export_grade")


STATE = """SELECT k, CAST(k % 2 AS int) AS n_slides, CAST(k % 3 AS int) AS n_clusters, CAST(k % 5 AS int) AS n_required, CAST(k % 7 AS int) % 2 AS n_required_matched,
    CAST(k % 4 AS int) AS n_substantive, k % 11 = 0 AS localizable, k % 3 = 0 AS multi_anchor FROM fx_account"""


@query("l10_bundle_status", f"""SELECT k, CASE WHEN (n_slides = 0 AND n_clusters = 0) OR (n_slides = 0 AND n_required > 0 AND n_required_matched = 0 AND NOT (n_substantive >= 2 OR (localizable AND n_substantive > 0)))
    OR (n_slides = 0 AND NOT (n_required > 0 AND n_required_matched = 0) AND (n_substantive = 0 OR (NOT multi_anchor AND n_substantive < 2 AND NOT localizable))) THEN 'unresolved' ELSE 'ready' END AS status FROM ({STATE}) x""")
def l10(b):
    return l.bundle_status(b.sql(STATE)).select("k", "status")


@query("l11_manifest", f"""SELECT report_id, CAST(count(*) AS int) AS n_findings, CAST(sum((status = 'ready')::int) AS int) AS n_ready, CAST(sum((status <> 'ready')::int) AS int) AS n_unresolved,
    CAST(sum((status <> 'ready' AND canonical)::int) AS int) AS n_blocking, CAST(sum((status = 'ready' AND export_grade)::int) AS int) AS n_exportable FROM ({BUNDLES}) x GROUP BY report_id""")
def l11(b):
    return l.manifest(b.sql(BUNDLES))


BOXED = "SELECT CAST(doc_id % 9 AS string) AS report_id, doc_id AS finding_id, page, x, y, width, height, kind FROM fx_box"
CITING = "SELECT report_id, finding_id, finding_id AS ord FROM (SELECT DISTINCT CAST(doc_id % 9 AS string) AS report_id, doc_id AS finding_id FROM fx_box) z"


@query("l12_box_exhibits", f"""SELECT report_id, page, x, y, width, height, string_agg(exhibit, ',' ORDER BY p) AS exhibits FROM (
    SELECT DISTINCT b.report_id, b.page, CAST(trunc(b.x) AS int) AS x, CAST(trunc(b.y) AS int) AS y, CAST(trunc(b.width) AS int) AS width, CAST(trunc(b.height) AS int) AS height, i.exhibit, i.p
    FROM ({BOXED}) b JOIN (SELECT report_id, finding_id, p, {LETTERS} AS exhibit FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS p FROM ({CITING}) c) y) i
      ON i.report_id = b.report_id AND i.finding_id = b.finding_id WHERE b.kind <> 'identity') x GROUP BY ALL""")
def l12_boxes(b):
    numbered = l.exhibits(b.sql(CITING))
    return l.box_exhibits(b.sql(BOXED), numbered).withColumn("exhibits", F.array_join("exhibits", ","))


ITEMS = "SELECT report_id, inquiry_ord AS ord, inquiry_ord AS finding_id FROM fx_inquiry"


@query("l12_exhibits", f"SELECT report_id, ord, {LETTERS} AS exhibit FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS p FROM ({ITEMS}) x) y")
def l12(b):
    return l.exhibits(b.sql(ITEMS)).select("report_id", "ord", "exhibit")




@query("l13_keyword_pages", f"""SELECT DISTINCT doc_id, CAST(pg AS int) AS page FROM (SELECT doc_id, unnest(range(greatest(page - 1, 1), least(page + 1, last) + 1)) AS pg FROM (
    SELECT *, max(hit) OVER (PARTITION BY doc_id) AS any_hit, max(page) OVER (PARTITION BY doc_id) AS last FROM (SELECT doc_id, page, contains(lower(page_text), ' zwar ') OR contains(lower(page_text), ' that ') AS hit FROM ora_page) x) y
    WHERE hit OR NOT any_hit) z""")
def l13(b):
    return l.keyword_pages(printed_pages(b), [" zwar ", " that "])


@query("l13_section_range", """SELECT doc_id, page FROM (SELECT p.doc_id, p.page, s.f, (SELECT min(e.page) FROM ora_page e WHERE e.doc_id = p.doc_id AND e.page > s.f AND contains(e.page_text, ' de ')) AS e
    FROM ora_page p JOIN (SELECT doc_id, min(page) AS f FROM ora_page WHERE contains(page_text, ' la ') OR contains(page_text, ' th') GROUP BY 1) s USING (doc_id)) x WHERE page >= f AND (e IS NULL OR page < e)""")
def l13_range(b):
    return l.section_range(printed_pages(b), " la | th", " de ")


@query("l14_page_quality", r"""SELECT doc_id, page, round(least(length(page_text) / 1800.0, 1), 6) AS text_quality,
    least(CASE WHEN regexp_matches(page_text, '(?i)account\s+type|revolving|installment|mortgage') THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(page_text, '\$\s*\d') THEN 0.3 ELSE 0 END, 1.0)::double AS table_quality FROM ora_page""")
def l14(b):
    return l.page_quality(printed_pages(b)).selectExpr("doc_id", "page", "round(text_quality, 6) AS text_quality", "table_quality")


MARKED = "SELECT doc_id, page, line_no AS row_no, line_no % 5 = 2 AS is_heading, line_no % 7 = 6 AND line_no % 5 <> 2 AS is_stop FROM fx_line"


@query("l15_entity_sections", f"""SELECT doc_id, page, row_no, CAST(n AS int) AS section_no FROM (SELECT *, sum(is_heading::int) OVER w AS n, last_value(CASE WHEN is_heading THEN 1 WHEN is_stop THEN 0 END IGNORE NULLS) OVER w AS open
    FROM ({MARKED}) x WINDOW w AS (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) y WHERE open = 1""")
def l15(b):
    return l.entity_sections(b.sql(MARKED), ["doc_id"])


MODES = "SELECT doc_id, page, line_no, line AS body, CASE line_no % 6 WHEN 1 THEN 'hard' WHEN 4 THEN 'soft' END AS mode, line_no % 3 = 1 AS starts FROM fx_line"


@query("l16_continuation_entries", f"""SELECT doc_id, page, CAST(e AS int) AS entry_no, min_by(md, line_no) AS section_mode, CAST(count(*) AS int) AS n_lines, md5(string_agg(body, ' ' ORDER BY line_no)) AS body FROM (
    SELECT *, sum(starts::int) OVER w AS e, last_value(mode IGNORE NULLS) OVER w AS md FROM ({MODES}) x WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) y
    WHERE e > 0 GROUP BY doc_id, page, e""")
def l16(b):
    return l.continuation_entries(b.sql(MODES)).selectExpr("doc_id", "page", "entry_no", "section_mode", "n_lines", "md5(body) AS body")


@query("l17_lanes", """SELECT doc_id, page, line_no, CASE WHEN word_no * 40 < 300 THEN 'left' ELSE 'right' END AS lane, md5(string_agg(word, ' ' ORDER BY word_no)) AS body
    FROM fx_word GROUP BY doc_id, page, line_no, CASE WHEN word_no * 40 < 300 THEN 'left' ELSE 'right' END""")
def l17(b):
    return l.lanes(b.sql(WORDS), 300.0).selectExpr("doc_id", "page", "line_no", "lane", "md5(text) AS body")


CANDIDATES = ("SELECT report_id AS finding_id, CASE k % 2 WHEN 0 THEN 'evidence' ELSE 'field' END AS kind, coalesce(status, '') AS text, CAST(k % 10 / 4.0 AS double) AS weight, k % 13 = 0 AS required FROM fx_account")


@query("l18_search_anchors", f"""SELECT finding_id, kind, lower(text) AS tokens, max(weight) AS weight, max(required::int) AS required FROM ({CANDIDATES}) x
    WHERE lower(text) NOT IN ('', 'not reported') GROUP BY finding_id, kind, lower(text)""")
def l18(b):
    return l.search_anchors(b.sql(CANDIDATES)).withColumn("required", F.col("required").cast("int"))


# --- incremental data -----------------------------------------------------------------------

SESSION = "SELECT event_id, ts, user_id, value, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS stage FROM events"


@query("t1_session_progress", f"""SELECT user_id, arg_max(greatest(0.0, least(99.0, value)), (ts, event_id)) AS progress, arg_max(stage, (ts, event_id)) FILTER (WHERE stage <> '') AS stage FROM ({SESSION}) x GROUP BY user_id""")
def t1(b):
    return t.session_progress(b.sql(SESSION)).select("user_id", "progress", "stage")


@query("t2_expired_sessions", """SELECT user_id FROM (SELECT user_id, max(ts) AS u FROM events GROUP BY user_id) x WHERE (SELECT max(ts) FROM events) - u > INTERVAL 4 HOURS""")
def t2(b):
    return t.expired_sessions(b.table("events"), 4 * 3600).select("user_id")


@query("t3_newest_by_key", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def t3(b):
    rows = b.table("events").withColumn("version", F.struct("ts", "event_id"))
    return t.newest_by_key(rows, ["user_id", "event_type"], "version").select("user_id", "event_type", "event_id")
