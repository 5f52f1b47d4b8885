"""Queries of sources, conforming, and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.catalog.binding import RAW_KEYS
from tradeglass.catalog.functions import adverse_pages
from tradeglass.catalog.history import features
from tradeglass.catalog.oracle import omoney
from tradeglass.catalog.registry import ORACLE_VIEWS, query
from tradeglass.operators.history import KEY, conflicts
from tradeglass.plans import findings as f
from tradeglass.plans.account_rules import RULES, rule_outcomes
from tradeglass.plans.account_view import account_view
from tradeglass.sources import payloads as s

ORACLE_VIEWS["ora_meta"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', '{r.issue}', '{r.category}', '{r.severity}', '{r.label}', {vocab.SEVERITY_ORDER[r.severity]}, {vocab.CATEGORY_RANK[r.category]}, "
    f"{vocab.CATALOG_CATEGORY_ORDER.index(r.category)})" for r in RULES
) + ") t(rule_id, issue_type, category, severity, issue_label, sev, cat, cat_order)"
DEMOTED = ", ".join(repr(i) for i in vocab.DEMOTED_ISSUES)
ORACLE_VIEWS["ora_finding"] = f"""
    SELECT o.*, m.issue_type, m.category, m.severity, m.sev, m.cat, m.issue_type || ':' || o.entity_key AS finding_id,
        CASE WHEN m.issue_type IN ({DEMOTED}) THEN 'strategy_demoted' WHEN m.category = 'legal_public_record' THEN 'explicit'
             WHEN neg OR (lay = 3 AND k % 5 + 1 IN (2, 4)) THEN 'negative_account' ELSE 'positive_account' END AS selection_basis,
        m.issue_type NOT IN ({DEMOTED}) AND (m.category = 'legal_public_record' OR neg OR (lay = 3 AND k % 5 + 1 IN (2, 4))) AS selected
    FROM ora_outcome o JOIN ora_meta m USING (rule_id) WHERE o.status = 'triggered'"""


def outcomes(b):
    b.shared_history()
    return rule_outcomes(b.tradelines(), b.cells())


def found(b):
    return f.account_findings(outcomes(b), adverse_pages(b))


# --- sources and conforming -----------------------------------------------------------


def payload_lines(b):
    """Payloads as JSON lines, several versions per file; a payload holds accounts of forty keys, so none grows."""
    accounts = "collect_list(struct(account_ord AS accountOrd, account_name AS accountName, account_number AS accountNumber, raw, comments, source_pages AS sourcePages))"
    grouped = b.tradelines().selectExpr("*", "cast(floor(account_ord / 40) AS string) AS chunk").groupBy(
        "report_id", "profile_id", "report_date", "chunk").agg(F.expr(f"{accounts} AS accounts"))
    envelope = ("named_struct('profile', 'unknown', 'fileName', concat(report_id, '-', cast(chunk AS int) % 10, '.pdf'), 'sourceFile', if(cast(chunk AS int) % 20 = 7, '', 'a.pdf'), "
                "'pageImages', array('1.png'), 'version', timestamp_seconds(1700000000 + cast(chunk AS int) * 60), 'result', "
                "named_struct('reportId', report_id, 'profile', profile_id, 'reportDate', report_date, 'accounts', accounts))")
    return grouped.selectExpr(f"to_json({envelope}) AS value")


@query("s1_read_payloads", "SELECT report_id, profile_id, CAST(k AS int) AS account_ord, entity_key, report_date FROM fx_account")
def s1(b):
    return s.tradelines(s.parse_results(payload_lines(b))).select("report_id", "profile_id", "account_ord", "entity_key", "report_date")


@query("s2_latest_versions", """SELECT profile_id, file_name, max(CAST(chunk AS int)) AS chunk FROM (SELECT profile_id, report_id || '-' || CAST(c % 10 AS string) || '.pdf' AS file_name,
    c AS chunk FROM (SELECT *, CAST(floor(k / 40.0) AS int) AS c FROM fx_account) a) x WHERE chunk % 20 <> 7 GROUP BY profile_id, file_name""")
def s2(b):
    return s.latest_versions(s.parse_results(payload_lines(b))).selectExpr(
        "profile_id", "file_name", "cast((unix_seconds(version) - 1700000000) / 60 AS int) AS chunk")


FED = "SELECT doc_id, replace(text, chr(10), chr(12)) AS text FROM documents"


@query("s3_split_pages", "SELECT doc_id, line_no AS page, md5(line) AS body FROM fx_line")
def s3(b):
    return s.split_pages(b.sql(FED), ["doc_id"]).selectExpr("doc_id", "page", "md5(page_text) AS body")


@query("s4_conform", """SELECT report_id, entity_key, profile_id, coalesce(status, '') AS status, coalesce(opened, '') AS date_opened, coalesce(e_rep, '') AS date_reported,
    coalesce(e_su, '') AS status_updated, coalesce(responsibility, '') AS responsibility, coalesce(address, '') AS address, phone,
    coalesce(CASE WHEN lay IN (1, 3) THEN coalesce(duration, terms) ELSE duration END, '') AS duration FROM ora_field""")
def s4(b):
    return s.conform(b.tradelines()).select("report_id", "entity_key", "profile_id", "status", "date_opened", "date_reported", "status_updated",
                                            "responsibility", "address", "phone", "duration")


@query("s5_account_view", f"""SELECT report_id, entity_key, CAST(nullif(pd_amt, 0) AS double) AS past_due_amt, CAST(nullif(co_amt, 0) AS double) AS charge_off_amt,
    opened_m, CAST(anchor_m AS int) AS anchor_m, CASE WHEN student AND k % 4 = 2 THEN 120 ELSE 84 END AS lookback, CAST(coll AS int) AS collection,
    CAST(plan AS int) AS plan, CAST(coalesce({omoney('high')}, bal_max) AS double) AS high_balance_amt, CAST(is_closed AS int) AS is_closed FROM ora_rule""")
def s5(b):
    names = ["past_due_amt", "charge_off_amt", "opened_m", "anchor_m", "lookback", "collection", "plan", "high_balance_amt", "is_closed"]
    v = account_view(b.tradelines(), b.cells(), set(names))
    return v.selectExpr(*KEY, "cast(nullif(past_due_amt, 0) AS double) AS past_due_amt", "cast(charge_off_amt AS double) AS charge_off_amt", "opened_m", "anchor_m",
                        "lookback", "cast(collection AS int) AS collection", "cast(plan AS int) AS plan", "cast(high_balance_amt AS double) AS high_balance_amt",
                        "cast(is_closed AS int) AS is_closed")


SOURCED = "SELECT report_id, entity_key, k AS ord, CAST(k % 6 AS int) AS page FROM fx_account WHERE address IS NOT NULL"


@query("s6_attach_sources", "SELECT report_id, entity_key, CASE WHEN address IS NOT NULL THEN CAST(k % 6 AS string) ELSE '1,2' END AS pages FROM fx_account")
def s6(b):
    sources = b.sql(SOURCED).selectExpr("report_id", "entity_key", "ord", "array(page) AS pages", "cast(array() AS array<string>) AS years")
    sections = b.view("fx_report").selectExpr("report_id", "array(1, 2) AS section_pages")
    return s.attach_sources(b.tradelines().select("report_id", "entity_key"), sources, sections).selectExpr(
        "report_id", "entity_key", "array_join(source_pages, ',') AS pages")


@query("s7_section_pages", """SELECT report_id, 'c' || CAST(k AS string) AS component, CASE WHEN k % 3 = k % 4 - 1 THEN CAST(k % 3 AS string) ELSE
    array_to_string(list_filter([k % 3, k % 4 - 1], lambda x: x > 0), ',') END AS pages FROM fx_account WHERE k % 3 > 0 OR k % 4 - 1 > 0""")
def s7(b):
    w = b.view("fx_account").selectExpr("report_id", "concat('c', k) AS component", "array(cast(k % 3 AS int), cast(k % 4 - 1 AS int), 0) AS pages")
    return s.section_pages(w).selectExpr("report_id", "component", "array_join(pages, ',') AS pages")


def key_case(names) -> str:
    return "CASE lay " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names) if n) + " END"


@query("s8_written_findings", "SELECT o.report_id, o.entity_key, a.profile_id, o.rule_id, o.status FROM ora_outcome o JOIN fx_account a ON a.k = o.k")
def s8(b):
    b.shared_history()
    rows = rule_outcomes(b.tradelines(), b.cells(), keep=[*KEY, "profile_id"])
    return s.written(rows.select(*KEY, "profile_id", "rule_id", "status"), "findings")


RAW_ROWS = " UNION ALL ".join(f"SELECT report_id, k, lay, name, number, {key_case(names)} AS key, {c} AS v FROM fx_account" for c, names in RAW_KEYS.items())


@query("s9_flatten_scalars", f"""SELECT report_id, 'accounts[' || CAST(k AS string) || '].' || key AS path, 'accounts' AS component, v AS value FROM ({RAW_ROWS}) x
    WHERE key IS NOT NULL AND v IS NOT NULL AND lower(v) NOT IN ('', '-', 'not reported', 'none')
      AND NOT (regexp_matches(v, '^[0-9,.%$]+$') AND length(regexp_replace(v, '[^0-9]', '', 'g')) <= 3)""")
def s9(b):
    return s.flatten_scalars(b.tradelines())


@query("s10_collections_from_accounts", """SELECT report_id, CAST(k AS int) AS ord, name AS agency, number, coalesce(original_creditor, '') AS creditor FROM fx_account WHERE reporting_category = 'Collection'""")
def s10(b):
    return s.collections_from_accounts(b.tradelines())


DETAILS = ("SELECT report_id, record_ord, 'Type: ' || record_type || ' ' || CAST(10000 + record_ord AS string) AS a, 'Court: ' || court AS b, 'Case number: ' || reference_number AS c, "
           "'Filed in person' AS d, 'Status: ' || status AS e, 'Balance: ' || amount AS g, record_type, court, reference_number, status FROM fx_public_record")


@query("s11_public_records", f"""SELECT report_id, record_ord, CASE WHEN record_type = '' THEN CAST(10000 + record_ord AS string) ELSE record_type END AS record_type,
    CASE WHEN reference_number <> '' THEN reference_number WHEN record_type = '' THEN '' ELSE CAST(10000 + record_ord AS string) END AS reference_number,
    court, status, d || ' | ' || g AS details FROM ({DETAILS}) x""")
def s11(b):
    return s.public_records(b.sql(DETAILS).selectExpr("report_id", "record_ord", "array(a, b, c, d, e, g) AS details")).select(
        "report_id", "record_ord", "record_type", "reference_number", "court", "status", "details")


@query("s12_provenance", f"""SELECT report_id, key AS field, CAST(k % 5 + 1 AS int) AS page, 'account:' || lower(name) || '::' ||
    CASE WHEN number = '' THEN 'Not reported' ELSE number END || ':field:' || key AS provenance_id FROM ({RAW_ROWS}) x WHERE key IS NOT NULL AND v IS NOT NULL""")
def s12(b):
    return s.provenance(b.tradelines()).select("report_id", "field", "page", "provenance_id")


ROWS = "SELECT report_id, k AS ord, CASE k % 4 WHEN 0 THEN 'Revolving' WHEN 1 THEN 'Mortgage' WHEN 2 THEN 'Total' ELSE 'Lease' END AS account_type, CAST(k AS string) AS total_accounts FROM fx_account"


@query("s13_contract_rows", f"""SELECT r.report_id, t.n AS row_no, t.ty AS account_type, coalesce((SELECT CAST(min(ord) AS string) FROM ({ROWS}) x WHERE x.report_id = r.report_id
    AND x.account_type = t.ty), 'Not reported') AS total_accounts FROM fx_report r CROSS JOIN (VALUES (1, 'Revolving'), (2, 'Mortgage'), (3, 'Installment'), (4, 'Other'), (5, 'Total')) t(n, ty)""")
def s13(b):
    return s.normalize_contract(b.view("fx_report"), b.sql(ROWS))


TABLE_ROW = "SELECT k, coalesce(status, '') AS st, coalesce(balance, '') AS bal FROM fx_account"


@query("s14_pairs_from_table", f"""SELECT k, 'accountStatus' AS field, CASE WHEN st = '' THEN '' ELSE st END AS value, CASE WHEN st = '' THEN 'blank' WHEN st = 'Not reported' THEN 'explicit_not_reported' ELSE 'value' END AS state FROM ({TABLE_ROW}) x
    UNION ALL SELECT k, 'currentBalance', bal, CASE WHEN bal = '' THEN 'blank' WHEN bal = 'Not reported' THEN 'explicit_not_reported' ELSE 'value' END FROM ({TABLE_ROW}) x
    UNION ALL SELECT k, 'dateOpened', '', 'blank' FROM ({TABLE_ROW}) x""")
def s14(b):
    rows = b.sql(TABLE_ROW).selectExpr("k", "array('Account Status:', '', st, 'Balance', bal, 'Date opened') AS cells")
    return s.pairs_from_table(rows, ["k"])


# --- findings -----------------------------------------------------------------------------


@query("k1_rule_outcomes", "SELECT report_id, entity_key, rule_id, status FROM ora_outcome")
def k1(b):
    return outcomes(b).select(*KEY, "rule_id", "status")


def conflict_findings(b):
    label = "concat(element_at(array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'), m % 12 + 1), ' ', cast(floor(m / 12) AS string))"
    return conflicts(features(b)).selectExpr(*KEY, "kind AS issue_type", "if(gap_len > 2, 'high', 'medium') AS severity", "m AS ord",
                                             f"concat('Coded ', code, ' in ', {label}) AS fact", "if(prev_m IS NULL, 'paymentHistory', 'prior') AS field")


@query("k2_merge_findings", """
    SELECT report_id, entity_key, issue_type, min(CASE WHEN gap_len > 2 THEN 0 ELSE 1 END) AS severity_rank, CAST(count(*) AS int) AS n_findings,
           string_agg(DISTINCT CASE WHEN prev_m IS NULL THEN 'paymentHistory' ELSE 'prior' END, ',' ORDER BY CASE WHEN prev_m IS NULL THEN 'paymentHistory' ELSE 'prior' END) AS fields,
           array_to_string(list('Coded ' || code || ' in ' || strftime(make_date(CAST(floor(m / 12.0) AS bigint), m % 12 + 1, 1), '%b %Y') ORDER BY m), '|') AS facts
    FROM (SELECT *, kind AS issue_type FROM ora_chain) x GROUP BY report_id, entity_key, issue_type""")
def k2(b):
    return f.merge_findings(conflict_findings(b)).selectExpr(*KEY, "issue_type", "severity_rank", "n_findings", "array_join(fields, ',') AS fields", "array_join(facts, '|') AS facts")


@query("k3_default_selection", "SELECT report_id, entity_key, issue_type, CAST(selected AS int) AS selected, selection_basis FROM ora_finding")
def k3(b):
    return found(b).selectExpr(*KEY, "issue_type", "cast(selected AS int) AS selected", "selection_basis")


@query("k4_ranked_findings", "SELECT report_id, finding_id, row_number() OVER (PARTITION BY report_id ORDER BY sev, cat, finding_id) AS rank FROM ora_finding")
def k4(b):
    return f.ranked_findings(found(b)).select("report_id", "finding_id", "rank")


@query("k5_catalog_order", f"""SELECT report_id, entity_key, o.rule_id, CAST(row_number() OVER (PARTITION BY report_id, entity_key ORDER BY cat_order,
    list_position({list(vocab.STATUS_ORDER)}, o.status), issue_label) AS int) AS position FROM ora_outcome o JOIN ora_meta m USING (rule_id)""")
def k5(b):
    return f.catalog_order(outcomes(b)).select(*KEY, "rule_id", "position")


MANUAL = "SELECT report_id, entity_key, k AS ord, coalesce(status, '') AS summary, type_text AS label, terms IS NOT NULL AS selected FROM fx_account"


@query("k6_manual_findings", f"""SELECT report_id, entity_key, finding_id, issue_type FROM ora_finding UNION ALL
    SELECT report_id, entity_key, 'manual:' || entity_key || ':' || CAST(ord AS string), 'manual' FROM ({MANUAL}) x WHERE selected AND summary <> ''""")
def k6(b):
    return f.with_manual(found(b), b.sql(MANUAL))


@query("k7_review_fallback", """SELECT report_id, 'report-review:' || report_id AS finding_id, 'report_review_request' AS issue_type FROM fx_report r
    WHERE NOT EXISTS (SELECT 1 FROM ora_finding x WHERE x.report_id = r.report_id AND x.rule_id = 'r25' AND x.selected)""")
def k7(b):
    some = f.account_findings(rule_outcomes(b.tradelines(), b.cells(), ["r25"]))
    return f.with_review_fallback(b.view("fx_report"), some)


@query("k8_display_months", """SELECT report_id, entity_key, m, row_number() OVER (PARTITION BY report_id, entity_key ORDER BY m) AS position,
    row_number() OVER (PARTITION BY report_id, entity_key ORDER BY m DESC) AS from_end FROM ora_cell WHERE der""")
def k8(b):
    return f.display_months(features(b).where("der").select(*KEY, "m"), KEY)


@query("k9_dispute_groups", """SELECT report_id, entity_key, n_findings, row_number() OVER (PARTITION BY report_id ORDER BY best) AS group_no FROM (
    SELECT report_id, entity_key, CAST(count(*) AS int) AS n_findings, min(rk) AS best FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY sev, cat, finding_id) AS rk
    FROM ora_finding WHERE selected) x GROUP BY report_id, entity_key) y""")
def k9(b):
    return f.dispute_groups(found(b)).select(*KEY, "n_findings", "group_no")


# texts of the history that stand in where a field is empty
ORACLE_VIEWS["ora_text"] = """
    SELECT c.report_id, c.entity_key, max_by(c.scheduled, CASE WHEN c.sched_amt > 0 THEN c.m END) AS sched_pos, max_by(c.paid, CASE WHEN c.paid_amt > 0 THEN c.m END) AS paid_pos,
           max_by(c.paid, CASE WHEN c.paid NOT IN ('-', '') THEN c.m END) AS paid_last, max_by(c.lpd, CASE WHEN c.lpd <> '--' THEN c.m END) AS lpd_last,
           max_by(c.balance, CASE WHEN c.bal IS NOT NULL THEN c.bal * 100000 - c.m END) AS bal_top FROM ora_cell c GROUP BY c.report_id, c.entity_key"""
BALANCE_SHOWN = "CASE WHEN balance = '' THEN 'Not reported' ELSE balance END"
CLOSURE = "CASE WHEN is_closed THEN coalesce(nullif(closed, ''), nullif(e_su, ''), e_bu) END"
# label -> value, for each label of each rule; where a label means different things the rule is named
SHOWN_SQL = {
    "number": "number", "status": "s", "balance": f"CASE WHEN balance IS NULL THEN bal_text ELSE {BALANCE_SHOWN} END", "address": "address", "phone": "phone",
    "past_due": "CASE WHEN past_due <> '' THEN past_due WHEN lay = 1 THEN CASE WHEN k % 12 = 2 THEN '$75.00' END ELSE due_text END",
    "charge_off": "coalesce(charge_off, CASE WHEN lay <> 2 AND k % 12 = 0 THEN '$1200.00' END)", "original_creditor": "original_creditor", "type": "type_text", "responsibility": "responsibility",
    "comments_shown": "comments", "additional": "additional", "statement": "NULL", "reinvestigation": "NULL", "legal_category": "legal_category", "months_reviewed": "months_reviewed", "date_opened": "opened",
    "payment_amount": "CASE lay WHEN 0 THEN coalesce(nullif(scheduled, ''), nullif(payment, ''), sched_pos, paid_pos) WHEN 1 THEN coalesce(nullif(scheduled, ''), sched_pos) "
                      "WHEN 2 THEN coalesce(nullif(payment, ''), nullif(scheduled, ''), paid_pos) ELSE coalesce(nullif(scheduled, ''), sched_pos, nullif(payment, ''), paid_last) END",
    "terms_shown": "CASE WHEN lay IN (1, 3) THEN coalesce(duration, terms) ELSE coalesce(duration, terms) END", "last_payment": "CASE WHEN lay = 2 THEN coalesce(last_payment, lpd_last) ELSE last_payment END",
    "recent_payment": "coalesce(nullif(payment, ''), CASE WHEN lay = 2 THEN paid_pos ELSE paid_last END)", "date_reported": "e_rep", "status_updated": "e_su", "balance_updated": "e_bu",
    "scheduled_shown": "CASE WHEN scheduled = '' THEN 'Not reported' ELSE scheduled END", "payment_shown": "CASE WHEN payment = '' THEN 'Not reported' ELSE payment END", "stated_last_payment": "last_payment",
    "terms": "terms", "duration": "CASE WHEN lay IN (1, 3) THEN coalesce(duration, terms) ELSE duration END", "closure_timing": CLOSURE,
    "closure_month": "CASE WHEN is_closed AND clo_m IS NOT NULL THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(clo_m % 12 AS int) * 3 + 1, 3) || ' ' || CAST(CAST(floor(clo_m / 12.0) AS int) AS string) END",
    "closure_status_shown": "CASE WHEN is_closed THEN upper(clo_code) END", "closure_paid_shown": "CASE WHEN is_closed THEN clo_paid END", "signal_shown": "CASE WHEN pay_rep THEN payment ELSE last_payment END",
    "high_balance": "coalesce(high, bal_top)", "credit_limit": "CASE WHEN lay = 1 THEN credit_limit ELSE coalesce(credit_limit, limit_text) END", "balance_shown": f"CASE WHEN balance IS NULL THEN 'Missing' ELSE {BALANCE_SHOWN} END",
    "first_delinquency": "dofd", "removal": "removal", "date_closed": "closed"}


@query("k10_observed_values", "SELECT report_id, entity_key, rule_id, label, coalesce(nullif(v, ''), 'Not reported') AS value FROM (" + " UNION ALL ".join(
    f"SELECT report_id, entity_key, '{r.id}' AS rule_id, '{label}' AS label, {SHOWN_SQL[c]} AS v FROM (SELECT * FROM ora_rule JOIN ora_text USING (report_id, entity_key)) z"
    for r in RULES for label, c in f.OBSERVED.get(r.id, f.OTHERWISE)) + ") x")
def k10(b):
    b.shared_history()
    return f.observed_facts(account_view(b.tradelines(), b.cells(), f.observed_columns()), [r.id for r in RULES])


@query("k11_rollup", """SELECT profile_id, severity, issue_type, CAST(count(*) AS int) AS n_findings FROM (SELECT x.*, r.profile_id FROM ora_finding x JOIN fx_report r USING (report_id)) y
    GROUP BY CUBE (profile_id, severity, issue_type)""")
def k11(b):
    return f.rollup_findings(outcomes(b).where("status = 'triggered'"))


@query("k12_evidence_refs", """SELECT DISTINCT report_id, entity_key, kind, role, CAST(ref_m AS int) AS ref_m FROM (
    SELECT report_id, entity_key, kind, 'conflict' AS role, m AS ref_m FROM ora_chain
    UNION ALL SELECT report_id, entity_key, kind, 'boundary', prev_m FROM ora_chain WHERE prev_m IS NOT NULL
    UNION ALL SELECT report_id, entity_key, kind, 'gap', unnest(range(prev_m + 1, m)) FROM ora_chain WHERE kind IN ('blank_gap', 'backfill')) x""")
def k12(b):
    return f.evidence_refs(conflicts(features(b)))

