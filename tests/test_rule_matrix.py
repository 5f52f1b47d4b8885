"""Golden one-account reports: a status sequence and fields in, one rule status out."""

import pytest

from tradeglass import schemas
from tradeglass.functions import dates
from tradeglass.operators import history as h
from tradeglass.plans.account_rules import BY_ID, RULES, rule_outcomes
from tradeglass.plans.account_view import entity_key

OLD, EXP, NEW, TU = "equifax_old_v1", "experian_acr_v1", "equifax_new_v1", "transunion_acr_v1"


def case(status, expected, year="2023", profile=OLD, series=None, raw=None, comments=(), dated=(), drop=(), account_type="Installment Loan"):
    base = {
        OLD: {"accountType": account_type, "status": "Open", "dateOpened": "01/01/2022", "balance": "$1000", "paymentAmount": "$100"},
        EXP: {"accountInfo.status": "Open", "accountInfo.dateOpened": "01/01/2022"},
        NEW: {"status": "Open", "dateOpened": "01/01/2022"},
        TU: {"accountInfo.payStatus": "Open", "accountInfo.dateOpened": "01/01/2022"},
    }[profile]
    fields = {**base, **(raw or {})}
    return dict(status=status, expected=expected, year=year, profile=profile, series=series or {}, comments=list(comments),
                raw={k: v for k, v in fields.items() if k not in drop}, dated=list(dated))


# name -> case; months count from January of the year
CASES = {
    "ok_to_60": case(["OK", "60"], {"r22": "triggered"}),
    "reaging": case(["30", "OK", "90"], {"r23": "triggered"}),
    "regression": case(["30", "60", "30"], {"r20": "triggered"}),
    "reset_then_30": case(["30", "60", "OK", "30"], {"r20": "not_triggered"}),
    "interval_28": case(["", "", "30"], {"r21": "triggered"}, raw={"dateReported": "03/28/2023", "lastPaymentDate": "02/28/2023"}),
    "interval_29": case(["", "30"], {"r21": "triggered"}, year="2024", raw={"dateReported": "02/29/2024", "lastPaymentDate": "01/31/2024"}),
    "interval_30": case(["", "", "30"], {"r21": "not_triggered"}, raw={"dateReported": "03/30/2023", "lastPaymentDate": "02/28/2023"}),
    "no_anchor": case(["", "", "30"], {"r21": "insufficient_evidence"}, series={"paid": {2: "$125"}, "balance": {1: "$1,000", 2: "$850"}}),
    "no_30": case(["OK", "OK"], {"r21": "not_applicable"}, raw={"dateReported": "03/28/2023", "lastPaymentDate": "02/28/2023"}),
    "first_30": case(["", "", "30"], {"r24": "triggered"}),
    "blank_gap": case(["OK", "", "90"], {"r26": "triggered"}),
    "open_gap": case(["OK", "OK"], {"r13": "triggered"}),
    "open_covered": case(["OK", "OK"], {"r13": "not_triggered"}, year="2022"),
    "student_2018": case(["OK", "OK"], {"r13": "triggered"}, year="2018", account_type="Student Loan",
                         raw={"dateOpened": "01/01/2014", "monthsReviewed": "120"}),
    "student_2016": case(["OK", "OK"], {"r13": "not_triggered"}, year="2016", account_type="Student Loan",
                         raw={"dateOpened": "01/01/2014", "monthsReviewed": "120 months"}),
    "co_no_buildup": case(["OK", "CO"], {"r28": "triggered"}, raw={"status": "Charge off"}),
    "plan_no_history": case([""] * 12, {"r29": "triggered"}, comments=["Account in forbearance plan"]),
    "plan_conflict": case(["OK", "90"], {"r30": "triggered"}, comments=["Repayment plan"]),
    "pay_and_balance": case(["30", "90"], {"r31": "triggered", "r32": "triggered"}, raw={"lastPaymentDate": "02/15/2023", "recentPayment": "$125"},
                            series={"paid": {1: "$125"}, "balance": {0: "$1,000", 1: "$820"}}),
    "balance_absent": case(["30", "60"], {"r42": "triggered"}, raw={"status": "120 days past due"}, drop=["balance"]),
    "balance_explicit": case(["30", "60"], {"r42": "not_triggered"}, raw={"status": "120 days past due", "balance": "Not reported"}),
    "no_scheduled": case(["OK", "OK"], {"r33": "triggered", "r34": "triggered"}, raw={"lastPaymentDate": "02/15/2023"}),
    "scheduled": case(["OK", "OK"], {"r33": "not_triggered"}, raw={"lastPaymentDate": "02/15/2023", "scheduledPaymentAmount": "$75"}),
    "amount": case(["OK", "OK"], {"r34": "not_triggered"}, raw={"lastPaymentDate": "02/15/2023", "actualPaymentAmount": "$75"}),
    "no_terms": case(["OK", "OK"], {"r35": "triggered"}, raw={"scheduledPaymentAmount": "$75"}),
    "terms": case(["OK", "OK"], {"r35": "not_triggered"}, raw={"scheduledPaymentAmount": "$75", "termDuration": "36 months", "termsFrequency": "Monthly"}),
    "layout_dated": case(["OK", "30"], {"r21": "triggered"}, profile=EXP, dated=[("01/31/2023", "$100"), ("02/28/2023", "$100")]),
    "layout_sections": case(["OK", "30"], {"r21": "triggered"}, profile=NEW,
                            series={"last_payment_date": {0: "01/31/2023", 1: "02/28/2023"}, "paid": {0: "$100", 1: "$100"}}),
    "layout_labelled": case(["", "", "30"], {"r21": "triggered"}, profile=TU, series={"paid": {1: "$100", 2: "$100"}},
                            raw={"accountInfo.dateUpdated": "03/28/2023", "accountInfo.lastPaymentMade": "02/28/2023", "accountInfo.paymentReceived": "$100"}),
    "closed_no_timing": case(["OK", "OK"], {"r50": "triggered"}, raw={"status": "Closed", "isClosed": "true"}),
    "closed_blank_month": case(["OK", ""], {"r36": "triggered"}, raw={"status": "Closed", "isClosed": "true", "dateClosed": "02/15/2023"}),
    "closed_signal": case(["OK", ""], {"r36": "triggered"}, raw={"status": "Closed", "isClosed": "true", "dateClosed": "02/15/2023", "lastPaymentDate": "02/12/2023"}),
    "closed_coherent": case(["OK", "OK"], {"r36": "not_triggered", "r37": "not_triggered"}, series={"paid": {1: "$125"}},
                            raw={"status": "Closed", "isClosed": "true", "dateClosed": "02/15/2023", "actualPaymentAmount": "$125"}),
    "closed_conflict": case(["OK", "OK"], {"r37": "triggered"}, series={"paid": {1: "$80"}},
                            raw={"status": "Closed", "isClosed": "true", "dateClosed": "02/15/2023", "actualPaymentAmount": "$125"}),
    "closed_scheduled_only": case(["OK", "OK"], {"r37": "not_triggered"}, series={"paid": {1: "$125"}},
                                  raw={"status": "Closed", "isClosed": "true", "dateClosed": "02/15/2023", "actualPaymentAmount": "$125", "scheduledPaymentAmount": "$180"}),
}


def tables(spark, cases):
    """Tradelines and cells of the cases, one report each."""
    lines = [(n, c["profile"], "2026-03-10", 0, "Synthetic Account", "123456789", c["raw"], c["comments"]) for n, c in cases.items()]
    t = spark.createDataFrame(lines, "report_id string, profile_id string, report_date string, account_ord int, account_name string, "
                                     "account_number string, raw map<string,string>, comments array<string>")
    t = t.selectExpr("*", f"{entity_key('account_name', 'account_number')} AS entity_key", "array(1) AS source_pages")
    key = "synthetic account::123456789"
    rows = []
    for n, c in cases.items():
        status = (c["status"] + [""] * 12)[:12]
        rows.append((n, key, "status", c["year"], *status))
        rows += [(n, key, s, c["year"], *[v.get(i) or "" for i in range(12)]) for s, v in c["series"].items()]
    wide = spark.createDataFrame(rows, "report_id string, entity_key string, series string, year string, "
                                 + ", ".join(f"{m} string" for m in h.MONTH_KEYS))
    cells = h.cells_from_year_rows(wide)
    # money series hold only the months they print
    cells = cells.where("series = 'status' OR value_text <> ''").select("report_id", "entity_key", "series", "m", "value_text")
    dated = [(n, key, d, paid) for n, c in cases.items() for d, paid in c["dated"]]
    if dated:
        e = spark.createDataFrame(dated, "report_id string, entity_key string, date string, paid string")
        m = dates.month_index(dates.parse_date("date"))
        cells = cells.unionByName(h.cells_from_dated_entries(e, {"paid": "paid"})).unionByName(
            e.selectExpr("report_id", "entity_key", "'paid_date' AS series", f"{m} AS m", "date AS value_text"))
    return t, cells.selectExpr("*", "'' AS state", "'' AS source", "0 AS ord")


@pytest.fixture(scope="module")
def statuses(spark):
    t, cells = tables(spark, CASES)
    rows = rule_outcomes(t, cells).select("report_id", "rule_id", "status").collect()
    return {(r.report_id, r.rule_id): r.status for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_case(statuses, name):
    for rule, expected in CASES[name]["expected"].items():
        assert statuses[(name, rule)] == expected, BY_ID[rule].issue


def test_catalogue_is_complete(statuses):
    assert len(RULES) == 53
    assert len(statuses) == 53 * len(CASES)


def test_other_reports_and_row_order_change_nothing(spark, statuses):
    few = {n: CASES[n] for n in ("reaging", "pay_and_balance", "interval_28")}
    t, cells = tables(spark, few)
    shuffled = cells.orderBy("value_text").repartition(3)
    rows = rule_outcomes(t.repartition(2), shuffled).select("report_id", "rule_id", "status").collect()
    assert {(r.report_id, r.rule_id): r.status for r in rows} == {k: v for k, v in statuses.items() if k[0] in few}


def test_declared_schemas_parse(spark):
    for name in ("CELL", "TRADELINE", "PUBLIC_RECORD", "INDICATOR", "INQUIRY", "PERSONAL", "INTAKE", "WORD", "DATED_ENTRY"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns
