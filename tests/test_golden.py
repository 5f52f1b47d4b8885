"""One golden case for each rule that reads more than one source: readiness, verification, inventory, posture, activity, references."""

from pyspark.sql import functions as F

from tradeglass.operators import linkage, quality
from tradeglass.plans import findings, references, report_rules


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_layout_is_ready_by_its_own_list(spark):
    rows = []
    for layout, needed in quality.REQUIRED.items():
        for gone in (None, needed[-1]):
            rows += [(f"{layout}-{gone}", layout, c, "failed" if c == gone else "complete") for c in needed] + [(f"{layout}-{gone}", layout, "notAsked", "failed")]
    rows.append(("thin", "experian_acr_v1", "accounts", "complete"))
    got = {r.report_id: r.ready for r in quality.readiness(spark.createDataFrame(rows, "report_id string, profile_id string, component string, status string")).collect()}
    assert got == {f"{x}-None": True for x in quality.REQUIRED} | {f"{x}-{n[-1]}": False for x, n in quality.REQUIRED.items()} | {"thin": False}


def test_verification_asks_for_required_components_and_fixtures(spark):
    reports = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("f",)], "report_id string")
    status = spark.createDataFrame([("a", "equifax_old_v1", "summary", "complete"), ("b", "equifax_old_v1", "softInquiries", "failed"), ("c", "equifax_old_v1", "summary", "failed"),
                                    ("d", "equifax_new_v1", "collections", "failed")], "report_id string, profile_id string, component string, status string")
    check = spark.createDataFrame([("a", "accounts", True), ("e", "accounts", False)], "report_id string, component string, pass boolean")
    issue = spark.createDataFrame([("a", "warning")], "report_id string, severity string")
    fixture = spark.createDataFrame([("a", True), ("f", False)], "report_id string, pass boolean")
    got = {r.report_id: r.verified for r in quality.verified_ready(reports, status, check, issue, fixture).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": False}


ACCOUNT = "report_id string, ord int, source string, account_name string, account_number string, date_opened string, date_reported string, balance string, status string, balance_state string, status_state string"


def account(report, ord_, source, name, number, reported="r"):
    return (report, ord_, source, name, number, "o", reported, "1", "s", "value", "value")


def test_inventory_restricts_accounts_found_in_text(spark):
    rows = [account("with", 1, "structured", "Bank", "12-3"), account("with", 2, "text", "BANK", "12-3"), account("with", 3, "text", "Other", "999"), account("with", 4, "text", "Bank", ""),
            account("with", 5, "text", "Plain", ""), account("without", 1, "text", "Other", "999"), account("without", 2, "text", "Other", "999", "later"), account("without", 3, "text", "Other", "999"),
            account("without", 4, "text", "2. Mortgage  Accounts", "77"), account("without", 5, "text", "Summary", "not reported")]
    got = linkage.dedup_accounts(spark.createDataFrame(rows, ACCOUNT), ["balance", "status"]).select("report_id", "name_key", "number_key", "ord", "n_merged")
    assert values(got) == values(spark.createDataFrame([("with", "bank", "12-3", 1, 1), ("with", "plain", "not reported", 5, 1), ("without", "other", "999", 1, 2), ("without", "not reported", "77", 4, 1)],
                                                       "a string, b string, c string, d int, e int"))


def test_posture_and_selection_by_adverse_pages(spark):
    accounts = spark.createDataFrame([("r", "a", "transunion_acr_v1", False, [3]), ("r", "b", "transunion_acr_v1", False, [5]), ("r", "c", "transunion_acr_v1", True, None), ("s", "d", "experian_acr_v1", False, [3]),
                                      ("t", "e", "transunion_acr_v1", None, [0, 3])], "report_id string, entity_key string, profile_id string, negative boolean, source_pages array<int>")
    adverse = spark.createDataFrame([("r", [0, 3]), ("s", [3])], "report_id string, adverse_pages array<int>")
    got = {r.entity_key: r.posture for r in findings.with_posture(accounts, adverse).collect()}
    assert got == {"a": "negative", "b": "positive", "c": "negative", "d": "positive", "e": "positive"}
    outcomes = accounts.selectExpr("*", "'triggered' AS status", "'r22' AS rule_id", "'severe_delinquency_jump_without_predecessor_support' AS issue_type", "'payment_history' AS category", "'high' AS severity")
    chosen = {r.entity_key: (r.selected, r.selection_basis) for r in findings.account_findings(outcomes, adverse).collect()}
    assert chosen["a"] == (True, "negative_account") and chosen["b"] == (False, "positive_account") and chosen["d"] == (False, "positive_account")


def test_an_account_is_active_by_any_of_its_status_texts(spark):
    indicators = spark.createDataFrame([("r", i, "A", "Included in bankruptcy", "bankruptcy", f"bank{i}", "") for i in range(4)],
                                       "report_id string, ind_ord int, code string, description string, category string, linked_name string, linked_number string")
    accounts = spark.createDataFrame([("r", 0, "Bank0", "", ["Closed", None], ["30", "OK"], "x", ""), ("r", 1, "Bank1", "", ["Closed"], ["30"], "x", ""), ("r", 2, "Bank2", "", [None, "Paid as  agreed"], [], "x", ""),
                                      ("r", 3, "Bank3", "", ["Open"], [], "in bankruptcy", "")],
                                     "report_id string, ord int, name string, number string, statuses array<string>, history array<string>, context string, legal_category string")
    assert values(report_rules.indicator_account_conflicts(indicators, accounts).select("ind_ord", "account_ord")) == [(0, 0), (2, 2)]


def test_references_of_a_severe_jump_and_a_late_balance(spark):
    cell = "report_id string, entity_key string, series string, m int, value_text string, state string, source string, provenance_id string, ord int"
    start = 2020 * 12
    rows = [("r", "a::1", "status", start + i, v, "", "", "", 0) for i, v in enumerate(["OK", "", "", "", "", "90", "OK"])] + [("r", "a::1", "balance", start + i, v, "", "", "", 0) for i, v in ((0, "$10"), (3, "$70"), (6, "$70"))]
    rows += [("r", "a::1", "gap_slot", start + 2, "", "missing_slot", "projected_gap_slot", "", 0), ("r", "b::2", "status", start, "OK", "", "", "", 0)]
    tradelines = spark.createDataFrame([("r", p, "2020-12-01", i, n, str(i), f"{n}::{i}", {"accountInfo.balanceUpdated": "Jan 2020", "accountInfo.status": "Open"}, [], [1]) for i, (n, p) in
                                        enumerate([("a", "experian_acr_v1"), ("b", "equifax_old_v1")], 1)],
                                       "report_id string, profile_id string, report_date string, account_ord int, account_name string, account_number string, entity_key string, raw map<string,string>, comments array<string>, source_pages array<int>")
    cells = spark.createDataFrame(rows, cell)
    refs = references.references(tradelines, cells)
    jump = {(r.label, r.m, r.field_name, r.expected) for r in refs.where("rule_id = 'r22'").collect()}
    assert jump == {("Earlier reported month", start, "paymentHistory", "OK"), ("Blank month before the severe jump", start + 1, "paymentHistory", None),
                    ("Blank month before the severe jump", start + 2, "paymentHistoryGapSlots", None), ("Blank month before the severe jump", start + 4, "paymentHistory", None),
                    ("Later severe delinquency month", start + 5, "paymentHistory", "90")}
    late = {(r.kind, r.field_name, r.ref_id) for r in refs.where("rule_id = 'r48'").collect()}
    assert late == {("field", "balanceUpdated", "account:a::1:field:balanceUpdated"), ("history_latest", "balanceHistory", "account:a::1:history-latest:balanceHistory")}
    assert values(references.resolved(refs, cells).where("rule_id = 'r48'").select("m", "value_text")) == [(start + 6, "$70")]
    assert refs.where("entity_key <> 'a::1'").count() == 0 and refs.count() == refs.distinct().count()
    assert refs.where(F.col("slide_id").contains("payment-severe-jump:a::1:2020-jan:2020-jun")).count() == 5
