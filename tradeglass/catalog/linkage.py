"""Queries of deduplication, merging, linkage and the rules outside accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeglass.catalog.binding import VIEWS
from tradeglass.catalog.oracle import omissing
from tradeglass.catalog.registry import query
from tradeglass.operators import linkage as k
from tradeglass.plans import report_rules as r

VIEWS["fx_person"] = """
    SELECT report_id, 'Pat Q Consumer ' || report_id AS name, CASE lay WHEN 0 THEN '12 Oak St, Dover, DE 19901' WHEN 1 THEN '12 Oak Street Dover DE 19901'
           ELSE CAST(CAST(report_id AS int) AS string) || ' Elm Ave' END AS address, '900-11-' || lpad(report_id, 4, '0') AS ssn1,
           CASE WHEN lay < 2 THEN '900-11-' || lpad(report_id, 4, '0') ELSE '900-22-' || lpad(report_id, 4, '0') END AS ssn2 FROM fx_report"""
VIEWS["fx_intake"] = """
    SELECT report_id, CASE lay WHEN 0 THEN 'Pat Q. Consumer ' || report_id WHEN 1 THEN 'PAT Q CONSUMER ' || report_id ELSE 'Pat Consumer Junior' END AS full_legal_name,
           '12 Oak St' AS line1, '' AS line2, 'Dover' AS city, 'DE' AS state, '19901' AS zip FROM fx_report"""
# accounts read by type and number, so identities really repeat inside a report
VIEWS["fx_raw_account"] = """
    SELECT report_id, k AS ord, CASE WHEN k % 29 = 0 THEN 'Account  Details' ELSE type_text END AS account_name, number AS account_number, coalesce(opened, '') AS date_opened,
           coalesce(reported, '') AS date_reported, CASE WHEN CAST(report_id AS int) % 3 = 0 AND k % 4 = 1 THEN 'structured' ELSE 'text' END AS source, balance, status,
           CASE WHEN balance IS NULL THEN NULL WHEN balance = '' THEN 'blank' WHEN balance = 'Not reported' AND k % 2 = 0 THEN 'explicit_not_reported' ELSE 'value' END AS balance_state,
           CASE WHEN status IS NULL THEN NULL ELSE 'value' END AS status_state FROM fx_account"""
VIEWS["fx_collection"] = """
    SELECT report_id, k AS ord, CASE k % 7 WHEN 0 THEN 'Collections stay on your report' WHEN 1 THEN '12' WHEN 2 THEN '' ELSE type_text || ' Recovery' END AS agency,
           CASE WHEN k % 4 = 0 THEN '' ELSE number END AS number, coalesce(original_creditor, CASE WHEN k % 3 = 0 THEN 'Chase' ELSE '' END) AS creditor,
           coalesce(charge_off, '') AS amount, coalesce(status, '') AS status FROM fx_account"""



def norm_number(x: str) -> str:
    return f"coalesce(nullif(trim(lower(regexp_replace({x}, '[^A-Za-z0-9*\\-\\s]', '', 'g'))), ''), 'not reported')"


@query("m1_account_dedup", f"""
    WITH n AS (SELECT * EXCLUDE (account_name), CASE WHEN account_name = 'Account  Details' THEN 'not reported' ELSE account_name END AS account_name, {norm_number('account_number')} AS nk FROM fx_raw_account),
    e AS (SELECT *, row_number() OVER (PARTITION BY report_id, account_name, nk, date_opened, date_reported, lower(coalesce(balance, '')), lower(coalesce(status, '')) ORDER BY ord) AS rn FROM n WHERE account_name <> 'not reported' OR nk <> 'not reported'),
    inv AS (SELECT DISTINCT report_id, account_name, nk FROM n WHERE source = 'structured' AND nk <> 'not reported'),
    d AS (SELECT * FROM e WHERE rn = 1 AND (nk = 'not reported' OR NOT EXISTS (SELECT 1 FROM n s WHERE s.report_id = e.report_id AND s.source = 'structured')
          OR EXISTS (SELECT 1 FROM inv i WHERE i.report_id = e.report_id AND i.account_name = e.account_name AND i.nk = e.nk)))
    SELECT report_id, lower(account_name) AS name_key, nk AS number_key, min(ord) AS ord, CAST(count(*) AS int) AS n_merged FROM d WHERE nk <> 'not reported' GROUP BY ALL
    UNION ALL SELECT report_id, lower(account_name), nk, ord, 1 FROM d WHERE nk = 'not reported' AND NOT EXISTS (
      SELECT 1 FROM d n WHERE n.report_id = d.report_id AND n.account_name = d.account_name AND n.nk <> 'not reported')
      AND NOT EXISTS (SELECT 1 FROM inv i WHERE i.report_id = d.report_id AND i.account_name = d.account_name)""".replace("WITH n", "SELECT * FROM (WITH n", 1) + ")")
def m1(b):
    return k.dedup_accounts(b.view("fx_raw_account"), ["balance", "status"]).select("report_id", "name_key", "number_key", "ord", "n_merged")


@query("m2_record_merge", """
    SELECT report_id, account_name, account_number, list_extract(bs, 1) AS x, CASE WHEN list_extract(st, 1) IN ('blank', 'explicit_not_reported') THEN list_extract(bs, 1)
           ELSE coalesce(list_extract(list_filter(bs, lambda v: v NOT IN ('', 'Not reported')), 1), list_extract(bs, 1)) END AS balance
    FROM (SELECT report_id, account_name, account_number, list(balance ORDER BY ord) FILTER (WHERE balance IS NOT NULL) AS bs,
                 list(balance_state ORDER BY ord) FILTER (WHERE balance IS NOT NULL) AS st FROM fx_raw_account GROUP BY ALL) z""".replace("list_extract(bs, 1) AS x, ", ""))
def m2(b):
    key = ["report_id", "account_name", "account_number"]
    return k.merge_records(b.view("fx_raw_account"), key, ["balance", "status"]).select(*key, "balance")


SCORED = ["agency", "number", "creditor", "amount", "status"]
SCORE = " + ".join(f"CAST({c} <> '' AS int)" for c in SCORED)


@query("m3_collection_dedup", f"""
    SELECT report_id, identity, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, ord) AS rn FROM (
      SELECT report_id, identity, min(ord) AS ord, {' + '.join(f"CAST(max({c}) <> '' AS int)" for c in SCORED)} AS score FROM (
        SELECT *, CASE WHEN agency <> '' AND coalesce(nullif(number, ''), creditor) <> '' THEN lower(agency) || '::' || lower(coalesce(nullif(number, ''), creditor))
                       ELSE 'row::' || CAST(ord AS string) END AS identity
        FROM fx_collection WHERE agency NOT LIKE 'Collections stay%' AND agency <> '12' AND {SCORE} >= 2) x GROUP BY report_id, identity) y) z
    JOIN (SELECT report_id AS rid, count(*) // 2 AS ec FROM fx_collection GROUP BY 1) e ON e.rid = z.report_id WHERE ec <= 0 OR rn <= ec""")
def m3(b):
    c = b.view("fx_collection")
    expected = c.groupBy("report_id").count().selectExpr("report_id", "cast(floor(count / 2) AS bigint) AS expected_count")
    return k.dedup_collections(c, expected, SCORED).select("report_id", "identity", "ord", "score")


@query("m4_collection_union", """SELECT report_id, min(ord) AS ord FROM fx_collection
    GROUP BY report_id, lower(agency), lower(number), lower(creditor), lower(amount), lower(status)""")
def m4(b):
    return k.union_collections(b.view("fx_collection")).select("report_id", "ord")


WHO = r"trim(regexp_replace(regexp_replace(lower(subscriber), ' promotional inquiry.*$', ''), '[\s,.;:]+$', ''))"


@query("m5_inquiry_merge", f"""
    WITH i AS (SELECT *, {WHO} AS who FROM fx_inquiry), p AS (SELECT * FROM i WHERE source = 'primary'), f AS (SELECT * FROM i WHERE source = 'fallback'),
    t AS (SELECT f.report_id, f.inquiry_ord, f.inquiry_date, f.who, f.purpose, f.page, min(p.inquiry_ord) AS po FROM f LEFT JOIN p ON p.report_id = f.report_id AND p.inquiry_date = f.inquiry_date
          AND (contains(p.who, f.who) OR contains(f.who, p.who)) GROUP BY ALL),
    -- names here nest, so the first one kept that matches is the smallest that matches
    u AS (SELECT a.report_id, a.inquiry_ord, min(b.inquiry_ord) AS po FROM t a JOIN t b ON a.po IS NULL AND b.po IS NULL AND b.report_id = a.report_id AND b.inquiry_date = a.inquiry_date
          AND (contains(a.who, b.who) OR contains(b.who, a.who)) GROUP BY ALL),
    r AS (SELECT report_id, inquiry_ord, purpose, page, inquiry_ord AS o FROM p UNION ALL SELECT t.report_id, t.inquiry_ord, t.purpose, t.page, coalesce(t.po, u.po) FROM t LEFT JOIN u ON u.report_id = t.report_id AND u.inquiry_ord = t.inquiry_ord),
    g AS (SELECT report_id, o, max(purpose) FILTER (inquiry_ord = o) AS own, min(inquiry_ord) FILTER (inquiry_ord <> o AND purpose <> '') AS bo, min_by(purpose, inquiry_ord) FILTER (inquiry_ord <> o AND purpose <> '') AS bp,
                 count(*) FILTER (inquiry_ord <> o) AS n FROM r GROUP BY report_id, o),
    q AS (SELECT report_id, o, string_agg(CAST(page AS string), ',' ORDER BY far, first) AS pages FROM (SELECT report_id, o, page, min(CASE WHEN inquiry_ord = o THEN 0 ELSE 1 END) AS far,
                 min(inquiry_ord) FILTER (WHERE inquiry_ord <> o) AS first FROM r WHERE page > 0 GROUP BY report_id, o, page) z GROUP BY report_id, o)
    SELECT g.report_id, CASE WHEN own = '' AND bo IS NOT NULL THEN bo ELSE g.o END AS inquiry_ord, CASE WHEN own = '' AND bo IS NOT NULL THEN bp ELSE own END AS purpose, n AS n_folded, coalesce(q.pages, '') AS pages
    FROM g LEFT JOIN q ON q.report_id = g.report_id AND q.o = g.o""".replace("WITH i", "SELECT * FROM (WITH i", 1) + ")")
def m5(b):
    return k.merge_inquiries(b.inquiries().withColumn("pages", F.array("page"))).withColumn("pages", F.array_join("pages", ","))


SUMMARY = ("SELECT report_id, type_text AS account_type, k AS ord, CASE k % 2 WHEN 0 THEN 'text' ELSE 'image' END AS source, CAST(k % 2 AS int) AS source_rank, "
           "CAST(CASE WHEN balance IS NULL THEN 0 ELSE 1 END + CASE WHEN status IS NULL THEN 0 ELSE 1 END + CASE WHEN terms IS NULL THEN 0 ELSE 1 END AS int) AS filled, "
           "CAST(k % 3 AS int) AS issues FROM fx_account")


@query("m6_summary_candidates", f"""SELECT report_id, account_type, source, ord, filled - issues AS score FROM (SELECT *, row_number() OVER (
    PARTITION BY report_id, account_type ORDER BY filled - issues DESC, source_rank, ord) AS rn FROM ({SUMMARY}) x) y WHERE rn = 1""")
def m6(b):
    return k.best_summary_rows(b.sql(SUMMARY))


FILLABLE = ("SELECT x.*, a.balance, a.terms, CASE WHEN a.balance = '' THEN 'blank' WHEN a.balance = 'Not reported' THEN 'explicit_not_reported' WHEN a.balance IS NULL THEN NULL ELSE 'value' END AS balance_state, "
            "CASE WHEN a.terms IS NULL THEN NULL ELSE 'value' END AS terms_state FROM (" + SUMMARY + ") x JOIN fx_account a ON a.k = x.ord")


@query("m6_filled_rows", f"""SELECT report_id, account_type, list(ord ORDER BY rn)[1] AS ord,
    CASE WHEN coalesce(list(balance ORDER BY rn)[1], '') <> '' OR coalesce(list(balance_state ORDER BY rn)[1] IN ('blank', 'explicit_not_reported'), false) THEN list(balance ORDER BY rn)[1]
         ELSE coalesce(list(balance ORDER BY rn) FILTER (WHERE coalesce(balance, '') <> '')[1], list(balance ORDER BY rn)[1]) END AS balance,
    coalesce(list(terms ORDER BY rn)[1], list(terms ORDER BY rn) FILTER (WHERE terms IS NOT NULL)[1]) AS terms
    FROM (SELECT *, row_number() OVER (PARTITION BY report_id, account_type ORDER BY filled - issues DESC, source_rank, ord) AS rn FROM ({FILLABLE}) f) y GROUP BY report_id, account_type""".replace(
    "list(balance ORDER BY rn) FILTER (WHERE coalesce(balance, '') <> '')[1]", "(list(balance ORDER BY rn) FILTER (WHERE coalesce(balance, '') <> ''))[1]").replace(
    "list(terms ORDER BY rn) FILTER (WHERE terms IS NOT NULL)[1]", "(list(terms ORDER BY rn) FILTER (WHERE terms IS NOT NULL))[1]"))
def m6_filled(b):
    return k.filled_summary_rows(b.sql(FILLABLE), ["balance", "terms"])


IND_ACCOUNTS = ("SELECT report_id, k AS ord, CASE WHEN k % 29 = 0 THEN 'A' ELSE '' END AS indicator, name, number, "
                "lower(coalesce(status, '') || ' ' || coalesce(legal_category, '')) AS context FROM fx_account")
IND_RECORDS = "SELECT report_id, record_ord AS ord, record_type, lower(record_type || ' ' || status) AS context FROM fx_public_record"


def known(x: str) -> str:
    return f"CASE WHEN {omissing(x)} THEN NULL ELSE {x} END"


@query("m7_indicator_union", f"""
    SELECT report_id, src, ord, code, description FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower(coalesce(code, '')), lower(description),
        lower(coalesce(ln, '')), lower(coalesce(lno, '')) ORDER BY src, ord) AS rn FROM (
      SELECT report_id, 1 AS src, ind_ord AS ord, nullif(code, '') AS code, coalesce(nullif(description, ''), nullif(code, ''), 'Consumer information indicator') AS description,
             nullif(linked_name, '') AS ln, nullif(linked_number, '') AS lno FROM fx_indicator
      UNION ALL SELECT report_id, 2, ord, nullif(indicator, ''), coalesce(nullif(indicator, ''), 'Bankruptcy-related account condition'), name, {known('number')}
      FROM ({IND_ACCOUNTS}) a WHERE indicator <> '' OR context LIKE '%bankruptcy%'
      UNION ALL SELECT report_id, 3, ord, NULL, coalesce(nullif(record_type, ''), 'Bankruptcy public record'), NULL, NULL FROM ({IND_RECORDS}) p
      WHERE regexp_matches(context, 'bankruptcy|chapter [0-9]+')) x) y WHERE rn = 1""")
def m7(b):
    return k.indicators(b.indicators(), b.sql(IND_ACCOUNTS), b.sql(IND_RECORDS)).select("report_id", "src", "ord", "code", "description")


VIEW_SIDE = "SELECT report_id, type_text AS entity_key, k AS view_ord, CAST(k % 5 + 1 AS int) AS pg FROM fx_account"
MAPPED = "SELECT report_id, type_text AS entity_key, k AS mapped_ord, CAST(k % 3 + 1 AS int) AS mpg, CAST(k % 4 AS int) AS n_fields FROM fx_account WHERE status IS NOT NULL"


@query("m8_view_to_mapped", f"""SELECT report_id, view_ord, mapped_ord FROM (SELECT v.report_id, v.view_ord, m.mapped_ord, row_number() OVER (PARTITION BY v.report_id, v.view_ord
    ORDER BY CASE WHEN v.pg = m.mpg THEN 0 ELSE 1 END, m.n_fields DESC, m.mapped_ord) AS rn FROM ({VIEW_SIDE}) v JOIN ({MAPPED}) m USING (report_id, entity_key)) z WHERE rn = 1""")
def m8(b):
    return k.match_accounts(b.sql(VIEW_SIDE).selectExpr("*", "array(pg) AS pages"), b.sql(MAPPED).selectExpr("*", "array(mpg) AS mapped_pages"))


LINK_ACCOUNTS = ("SELECT a.report_id, a.k AS ord, name, number, coalesce(a.status, '') AS own_status, coalesce(h.first_code, '') AS first_code, coalesce(h.some_ok, '') AS some_ok, coalesce(legal_category, '') AS legal_category, "
                 "name || ' ' || coalesce(a.status, '') AS context FROM fx_account a LEFT JOIN (SELECT k, min(status) AS first_code, max(CASE WHEN status = 'OK' THEN 'OK' ELSE '' END) AS some_ok FROM fx_hist GROUP BY k) h ON h.k = a.k")
FLAT = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
DIGITS = "right(regexp_replace({0}, '[^0-9]', '', 'g'), 4)"
LINKED = f"""SELECT i.*, (SELECT min(a.ord) FROM ({LINK_ACCOUNTS}) a WHERE a.report_id = i.report_id AND (
      ({FLAT.format('i.linked_name')} <> '' AND contains({FLAT.format('a.name')}, {FLAT.format('i.linked_name')}))
      OR ({DIGITS.format('i.linked_number')} <> '' AND {DIGITS.format('a.number')} = {DIGITS.format('i.linked_number')}))) AS account_ord FROM fx_indicator i"""


@query("m9_indicator_account_link", f"SELECT report_id, ind_ord, account_ord FROM ({LINKED}) x")
def m9(b):
    return k.link_indicators(b.indicators(), b.sql(LINK_ACCOUNTS)).select("report_id", "ind_ord", "account_ord")


WANTED = "SELECT report_id, k AS want_ord, type_text AS name, number, CAST(k % 5 + 1 AS int) AS pg FROM fx_account"
HELD = ("SELECT report_id, k AS account_ord, type_text AS account_name, number AS account_number, CAST(k % 3 + 1 AS int) AS apg, CAST(k % 4 AS int) AS coverage "
        "FROM fx_account WHERE status IS NOT NULL")
TAIL = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 6 THEN right({0}, 6) WHEN {0} = 'Not reported' THEN 'ported' WHEN {0} LIKE 'XXXX%' THEN substr({0}, 5) ELSE '' END"


@query("m10_evidence_account", f"""SELECT report_id, want_ord, account_ord FROM (SELECT w.report_id, w.want_ord, a.account_ord, row_number() OVER (PARTITION BY w.report_id, w.want_ord
    ORDER BY CASE WHEN {TAIL.format('w.number')} <> '' AND {TAIL.format('w.number')} = {TAIL.format('a.account_number')} THEN 0 ELSE 1 END,
    CASE WHEN w.pg = a.apg THEN 0 ELSE 1 END, a.coverage DESC, a.account_ord) AS rn FROM ({WANTED}) w JOIN ({HELD}) a ON a.report_id = w.report_id AND a.account_name = w.name) z WHERE rn = 1""")
def m10(b):
    return k.lookup_accounts(b.sql(WANTED).selectExpr("*", "array(pg) AS pages"), b.sql(HELD).selectExpr("*", "array(apg) AS a_pages"))


REF = FLAT.format("reference_number")
IDENTITY = (f"CASE WHEN {REF} <> '' THEN 'reference:' || {REF} WHEN record_type <> '' AND court <> '' AND date_filed <> '' "
            f"THEN 'type-court-filed:' || {FLAT.format('record_type')} || ':' || {FLAT.format('court')} || ':' || date_filed ELSE '' END")


@query("m11_record_identity", f"SELECT report_id, record_ord, {IDENTITY} AS identity FROM fx_public_record")
def m11(b):
    return b.public_records().selectExpr("report_id", "record_ord", f"{k.public_record_key()} AS identity")


PAGES = "SELECT report_id, kind AS component, page FROM fx_inquiry UNION ALL SELECT report_id, 'accounts', CAST(k % 5 AS int) FROM fx_account"


@query("m12_component_pages", f"SELECT DISTINCT report_id, component, page FROM ({PAGES}) x WHERE page > 0")
def m12(b):
    return k.component_pages(b.sql(PAGES))


REASONS = "SELECT report_id, subscriber || '|' || kind AS id, inquiry_ord AS ord FROM fx_inquiry"


@query("m13_first_reason", f"SELECT report_id, id, min(ord) AS ord FROM ({REASONS}) x GROUP BY report_id, id")
def m13(b):
    return k.keep_first(b.sql(REASONS), {"k_report": "report_id", "k_id": "id"}).select("report_id", "id", "ord")


OPEN_SQL = "SELECT report_id, entity_key, closed IS NOT NULL AS is_closed FROM fx_account"


@query("m14_account_counts", f"""SELECT report_id, entity_key, CAST(count(*) FILTER (WHERE NOT is_closed) OVER w AS int) AS n_open,
    CAST(count(*) FILTER (WHERE is_closed) OVER w AS int) AS n_closed, CAST(count(*) OVER w AS int) AS n_total FROM ({OPEN_SQL}) x WINDOW w AS (PARTITION BY report_id)""")
def m14(b):
    return k.with_account_counts(b.sql(OPEN_SQL)).drop("is_closed")


# --- rules outside accounts ----------------------------------------------------------


@query("p1_public_record_duplicates", f"""SELECT report_id, identity, CAST(count(*) AS int) AS n_records FROM (
    SELECT report_id, {IDENTITY} AS identity FROM fx_public_record) x WHERE identity <> '' GROUP BY ALL HAVING count(*) > 1""")
def p1(b):
    return r.duplicate_records(b.public_records())


NO_REF = "(reference_number IN ('', 'None'))"


@query("p2_public_record_core_details", f"""SELECT report_id, record_ord, array_to_string(list_filter([CASE WHEN record_type = '' THEN 'record type' END,
    CASE WHEN date_filed = '' THEN 'filed date' END, CASE WHEN court = '' AND {NO_REF} THEN 'court or reference number' WHEN court = '' THEN 'court'
    WHEN {NO_REF} THEN 'reference number' END], lambda x: x IS NOT NULL), ', ') AS missing FROM fx_public_record
    WHERE record_type = '' OR date_filed = '' OR (court = '' AND {NO_REF})""")
def p2(b):
    return r.incomplete_records(b.public_records()).select("report_id", "record_ord", "missing")


@query("p3_public_record_obsolete", """SELECT p.report_id, p.record_ord FROM fx_public_record p JOIN fx_report r USING (report_id)
    WHERE (date_filed <> '' OR date_resolved <> '') AND (year(r.report_day) * 12 + month(r.report_day)) - (year(day) * 12 + month(day))
          >= CASE WHEN record_type LIKE '%Bankruptcy%' THEN 120 ELSE 84 END""")
def p3(b):
    return r.obsolete_records(b.public_records(), b.view("fx_report")).select("report_id", "record_ord")


@query("p4_public_record_restricted", """SELECT report_id, record_ord FROM fx_public_record
    WHERE regexp_matches(lower(status), 'dismissed|released') AND regexp_matches(lower(status), 'open|filed')""")
def p4(b):
    return r.restricted_records(b.public_records()).select("report_id", "record_ord")


@query("p5_indicator_core_details", "SELECT report_id, ind_ord FROM fx_indicator WHERE description = '' OR ((linked_name = '') <> (linked_number = ''))")
def p5(b):
    return r.incomplete_indicators(b.indicators()).select("report_id", "ind_ord")


@query("p6_indicator_account_conflict", f"""SELECT x.report_id, x.ind_ord, x.account_ord FROM ({LINKED}) x JOIN ({LINK_ACCOUNTS}) a ON a.report_id = x.report_id AND a.ord = x.account_ord
    WHERE (x.category = 'bankruptcy') AND regexp_matches(lower(a.own_status || ' ' || a.first_code || ' ' || a.some_ok), 'current|open|paid as agreed|ok') AND a.legal_category <> 'bankruptcy' AND lower(a.context) NOT LIKE '%bankruptcy%'""")
def p6(b):
    accounts = b.sql(LINK_ACCOUNTS).selectExpr("*", "array(own_status) AS statuses", "array(first_code, some_ok) AS history")
    return r.indicator_account_conflicts(b.indicators(), accounts).select("report_id", "ind_ord", "account_ord")


def people(b):
    return b.view("fx_person").selectExpr("report_id", "name", "array(address) AS addresses", "array(ssn1, ssn2) AS ssns")


@query("p7_multiple_ssns", """SELECT report_id, 2 AS n_values, array_to_string(list_sort([sha256(report_id || ':' || ssn1), sha256(report_id || ':' || ssn2)]), '|') AS hashes
    FROM fx_person WHERE ssn1 <> ssn2""")
def p7(b):
    return r.multiple_ssns(people(b))


@query("p8_name_mismatch", f"""SELECT report_id FROM fx_person JOIN fx_intake USING (report_id) WHERE {FLAT.format('name')} <> {FLAT.format("replace(full_legal_name, 'Junior', 'Jr')")}""")
def p8(b):
    return r.name_mismatches(people(b), b.view("fx_intake"))


@query("p9_address_mismatch", f"""SELECT report_id FROM fx_person WHERE NOT contains({FLAT.format('address')}, '12oakstdoverde19901') AND NOT contains('12oakstdoverde19901', {FLAT.format('address')})""")
def p9(b):
    return r.address_mismatches(people(b), b.view("fx_intake"))


