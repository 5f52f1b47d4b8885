"""The 53 per-account rules as data: id, issue, category, severity, and three tests over the view.

triggered wins over applicability (a finding counts even where the rule would not
apply); then not_applicable; then not_triggered or insufficient_evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions.money import amount
from tradeglass.functions.text import contains_any, lit, missing, names_in, one_of, rx
from tradeglass.operators.history import KEY, count_runs, latest_balance
from tradeglass.operators.skew import salted_join
from tradeglass.plans.account_view import account_view, money_state, with_anchors
from tradeglass.vocab import RULE_NAMES


@dataclass(frozen=True)
class Rule:
    id: str
    issue: str
    label: str
    category: str
    severity: str
    triggered: str
    applies: str = "true"
    evaluable: str = "true"
    runs: str = "1"  # findings per account, where one rule can report several runs of months


def has(name: str) -> str:
    return f"NOT {missing(name)}"


def lacks(name: str) -> str:
    return missing(name)


def shown(name: str) -> str:
    """A history table value that is neither missing nor a blank code."""
    return f"(NOT {missing(name)} AND NOT {one_of(f'lower({name})', vocab.BLANK_CODES)})"


def uncovered(series: str) -> str:
    """Derogatory months before the first record of one money table, two or more."""
    return f"coalesce(size(filter(der_months, x -> x < {series}_cover_m)) >= 2, false)"


def listed(months: str) -> str:
    return f"coalesce(size({months}) > 0, false)"


def above(value: str, observed: str) -> str:
    return f"coalesce({value} > 0 AND {observed} > 0 AND {value} > {observed}, false)"


CELLS = "n_cells > 0"
NEW_FORM = "profile_id = 'equifax_new_v1'"
SECTION_CELLS = "n_balance_cells + n_paid_cells + n_past_due_cells + n_credit_limit_cells + n_last_payment_date_cells > 0"
# Balance cells, or any 24-month section in the layout that prints them.
BALANCE_CELLS = f"(n_balance_cells > 0 OR ({NEW_FORM} AND {SECTION_CELLS}))"
# Blank months inside the reported range and after opening; one layout needs proven slots.
MISSING_MONTHS = (
    "filter(if(profile_id = 'experian_acr_v1', provable_blank_months, blank_months), "
    "x -> x > first_seen_m AND x < last_seen_m AND x > coalesce(opened_m, -1))")
BALANCE_GAPS = "filter(seen_without_balance, x -> x > first_balance_m AND x < last_balance_m)"
RECENT = f"coalesce({amount('recent_payment')} > 0, false)"
ACTIVITY_CONFLICT = (
    "(n_seq_active > 0 OR coalesce(exists(chain_months, x -> abs(x - last_payment_m) <= 2), false) "
    f"OR (n_chain > 0 AND {RECENT}))")
ANY_ACTIVITY = f"(n_paid_pos > 0 OR n_scheduled_pos > 0 OR {RECENT} OR {has('last_payment')} OR n_last_payment_dates > 0)"
OPEN = "NOT collection AND NOT is_closed"
OPEN_INSTALLMENT = f"({OPEN} AND installment AND NOT revolving)"
RECENT_CURRENT = "coalesce(last_cur_m >= last_seen_m - 2, false)"
CLOSURE_BLANK = one_of("lower(coalesce(closure_status, ''))", vocab.BLANK_CODES)
CLOSURE_ACTIVITY = (f"({shown('closure_status')} OR {shown('closure_paid')} "
                    f"OR ({NEW_FORM} AND {shown('closure_last_payment')}))")
PAYMENT_SIGNAL = f"({has('payment_state.value')} OR {has('stated_last_payment')})"
CLOSURE_AMOUNT = f"(closure_m IS NOT NULL AND {has('payment_state.value')} AND {shown('closure_paid')})"
CLOSURE_DIFFERS = f"coalesce(abs({amount('payment_state.value')} - {amount('closure_paid')}) >= 0.01, false)"
CHARGE_OFF = "(contains(lower(status), 'charge off') OR charge_off_pos)"
STATED_YEAR = f"regexp_extract(first_delinquency, {rx(r'\b(?:19|20)[0-9]{2}\b')}, 0)"
RESPONSIBLE = contains_any("lower(responsibility)", vocab.RESPONSIBILITY_WORDS)
REMOVAL_GAP = "(removal_m - first_delinquency_m)"
BOTH_DATES = f"({has('first_delinquency')} AND {has('removal')})"

ID, HIST, BAL = "account_identity", "payment_history", "balance_amount"
CO, LEGAL, DATE = "charge_off_collection", "legal_public_record", "date_reporting_timeline"
HIGH, MED, LOW = "high", "medium", "low"


RULES = [
    Rule("r01", *RULE_NAMES["r01"], ID, HIGH, "duplicate_conflict"),
    Rule("r02", *RULE_NAMES["r02"], ID, HIGH, "incomplete_number"),
    Rule("r03", *RULE_NAMES["r03"], ID, MED,
         f"{lacks('address')} AND {lacks('phone')}"),
    Rule("r04", *RULE_NAMES["r04"], ID, MED,
         f"{lacks('status')} AND (collection OR past_due_pos_flag OR charge_off_pos OR n_der > 0)", "negative"),
    Rule("r05", *RULE_NAMES["r05"], ID, MED,
         "collection AND NOT usable_creditor", "collection"),
    Rule("r06", *RULE_NAMES["r06"], ID, MED,
         "student_loan AND NOT usable_creditor", "student_loan"),
    Rule("r07", *RULE_NAMES["r07"], ID, LOW,
         RESPONSIBLE, RESPONSIBLE, has("responsibility")),
    Rule("r08", *RULE_NAMES["r08"], LEGAL, HIGH, "litigation", "litigation"),
    Rule("r09", *RULE_NAMES["r09"], HIST, HIGH,
         f"NOT present AND {OPEN} AND NOT coalesce(anchor_m - opened_m < 2, false)", OPEN),
    Rule("r10", *RULE_NAMES["r10"], HIST, HIGH,
         "derogatory_status AND NOT present", "negative"),
    Rule("r11", *RULE_NAMES["r11"], HIST, MED,
         f"present AND {listed(MISSING_MONTHS)}", evaluable=CELLS, runs=count_runs(MISSING_MONTHS)),
    Rule("r12", *RULE_NAMES["r12"], HIST, HIGH,
         " OR ".join(uncovered(s) for s in ("balance", "past_due", "paid", "scheduled")), evaluable=CELLS),
    Rule("r13", *RULE_NAMES["r13"], HIST, MED, "coalesce(first_seen_m > expected_m, false)", evaluable=f"{CELLS} AND {has('date_opened')}"),
    Rule("r14", *RULE_NAMES["r14"], HIST, MED,
         f"{OPEN_INSTALLMENT} AND {lacks('payment_amount')}", OPEN_INSTALLMENT),
    Rule("r15", *RULE_NAMES["r15"], HIST, MED, f"{OPEN} AND {RECENT_CURRENT} AND {lacks('recent_payment')} AND {lacks('last_payment')}",
         f"{OPEN} AND {RECENT_CURRENT}", CELLS),
    Rule("r16", *RULE_NAMES["r16"], HIST, HIGH, f"{NEW_FORM} AND {listed('past_due_conflict_months')}", NEW_FORM,
         f"n_past_due_cells > 0 AND {CELLS}", count_runs("past_due_conflict_months")),
    Rule("r17", *RULE_NAMES["r17"], HIST, MED,
         f"{NEW_FORM} AND {listed('activity_conflict_months')}", NEW_FORM, f"{SECTION_CELLS} AND {CELLS}",
         count_runs("activity_conflict_months")),
    Rule("r18", *RULE_NAMES["r18"], HIST, HIGH,
         f"past_due_pos_flag AND present AND only_current AND NOT {listed('past_due_conflict_months')}",
         "past_due_pos_flag", CELLS),
    Rule("r19", *RULE_NAMES["r19"], HIST, HIGH,
         "n_der = 0 AND coalesce(past_due_max > 0, false)", evaluable=f"n_past_due_cells > 0 AND {CELLS}"),
    Rule("r20", *RULE_NAMES["r20"], HIST, HIGH,
         "n_regression > 0", evaluable=CELLS),
    Rule("r21", *RULE_NAMES["r21"], HIST, HIGH,
         "n_short_intervals > 0", "n_30 > 0", "n_interval_months > 0"),
    Rule("r22", *RULE_NAMES["r22"], HIST, HIGH, "n_severe_jump > 0", evaluable=CELLS),
    Rule("r23", *RULE_NAMES["r23"], HIST, HIGH,
         "n_reaging > 0", evaluable=CELLS),
    Rule("r24", *RULE_NAMES["r24"], HIST, HIGH,
         "n_first_30 > 0", evaluable=f"{CELLS} AND {has('date_opened')}"),
    Rule("r25", *RULE_NAMES["r25"], HIST, HIGH,
         "n_first_severe > 0", evaluable=f"{CELLS} AND {has('date_opened')}"),
    Rule("r26", *RULE_NAMES["r26"], HIST, HIGH,
         "n_blank_gap > 0", evaluable=CELLS),
    Rule("r27", *RULE_NAMES["r27"], HIST, HIGH, "n_backfill > 0", evaluable=CELLS),
    Rule("r28", *RULE_NAMES["r28"], HIST, HIGH, "n_no_build_up > 0", evaluable=CELLS),
    Rule("r29", *RULE_NAMES["r29"], HIST, HIGH, "plan AND NOT present", "plan"),
    Rule("r30", *RULE_NAMES["r30"], HIST, HIGH,
         "plan AND present AND n_chain > 0", "plan", CELLS),
    Rule("r31", *RULE_NAMES["r31"], HIST, HIGH,
         ACTIVITY_CONFLICT, evaluable=f"{CELLS} AND {ANY_ACTIVITY}"),
    Rule("r32", *RULE_NAMES["r32"], HIST, HIGH,
         "n_seq_balance_drop > 0", evaluable=f"{CELLS} AND {BALANCE_CELLS}"),
    Rule("r33", *RULE_NAMES["r33"], HIST, MED,
         f"{has('stated_last_payment')} AND NOT scheduled_reported", has("stated_last_payment")),
    Rule("r34", *RULE_NAMES["r34"], HIST, MED,
         f"{has('stated_last_payment')} AND NOT payment_reported", has("stated_last_payment")),
    Rule("r35", *RULE_NAMES["r35"], HIST, MED,
         f"scheduled_reported AND {lacks('terms')} AND {lacks('duration')}", "scheduled_reported"),
    Rule("r36", *RULE_NAMES["r36"], HIST, HIGH,
         f"is_closed AND closure_m IS NOT NULL AND ({CLOSURE_BLANK} OR ({PAYMENT_SIGNAL} AND NOT {CLOSURE_ACTIVITY}))",
         "is_closed", "closure_m IS NOT NULL"),
    Rule("r37", *RULE_NAMES["r37"], HIST, HIGH,
         f"is_closed AND {CLOSURE_AMOUNT} AND {CLOSURE_DIFFERS}", "is_closed", CLOSURE_AMOUNT),
    Rule("r38", *RULE_NAMES["r38"], BAL, MED,
         above("high_balance_amt", "observed_balance_max"), "coalesce(high_balance_amt > 0, false)", BALANCE_CELLS),
    Rule("r39", *RULE_NAMES["r39"], BAL, HIGH, "installment AND NOT revolving AND n_flat_drop > 0", "NOT is_closed AND installment",
         f"{BALANCE_CELLS} AND n_paid_cells > 0"),
    Rule("r40", *RULE_NAMES["r40"], BAL, MED,
         f"coalesce(size({BALANCE_GAPS}) >= 2, false)", evaluable=f"{BALANCE_CELLS} AND {CELLS}",
         runs=count_runs(BALANCE_GAPS)),
    Rule("r41", *RULE_NAMES["r41"], BAL, MED,
         above("credit_limit_amt", "credit_limit_max"), "coalesce(credit_limit_amt > 0, false)",
         "n_credit_limit_cells > 0"),
    Rule("r42", *RULE_NAMES["r42"], BAL, HIGH,
         "derogatory_status AND balance_state.state = 'missing_field'", "negative"),
    Rule("r43", *RULE_NAMES["r43"], BAL, MED,
         "derogatory_status AND present AND balance_max IS NULL", "negative"),
    Rule("r44", *RULE_NAMES["r44"], CO, HIGH,
         f"{CHARGE_OFF} AND present AND only_current AND n_co = 0", CHARGE_OFF, CELLS),
    Rule("r45", *RULE_NAMES["r45"], CO, HIGH,
         "collection AND present AND n_cur > 0 AND NOT plan", "collection", CELLS),
    Rule("r46", *RULE_NAMES["r46"], DATE, HIGH, f"coalesce({STATED_YEAR} <> '' AND cast(floor(first_der_m / 12) AS string) <> {STATED_YEAR}, false)",
         has("first_delinquency"), CELLS),
    Rule("r47", *RULE_NAMES["r47"], DATE, MED,
         "coalesce(last_seen_m - status_updated_m > 2, false)", has("status_updated"), CELLS),
    Rule("r48", *RULE_NAMES["r48"], DATE, MED,
         "coalesce(last_balance_m - balance_updated_m > 2, false)", has("balance_updated"), BALANCE_CELLS),
    Rule("r49", *RULE_NAMES["r49"], DATE, HIGH,
         f"coalesce({REMOVAL_GAP} < 78 OR {REMOVAL_GAP} > 96, false)", BOTH_DATES, BOTH_DATES),
    Rule("r50", *RULE_NAMES["r50"], DATE, MED,
         f"is_closed AND {lacks('closure_timing')}", "is_closed"),
    Rule("r51", *RULE_NAMES["r51"], DATE, MED,
         f"(negative OR balance_reported) AND {lacks('date_reported')}", "negative OR balance_reported"),
    Rule("r52", *RULE_NAMES["r52"], DATE, MED,
         f"negative AND {lacks('status_updated')}", "negative"),
    Rule("r53", *RULE_NAMES["r53"], DATE, MED,
         f"balance_reported AND {lacks('balance_updated')}", "balance_reported"),
]
BY_ID = {r.id: r for r in RULES}


def duplicate_conflicts(tradeline: DataFrame, cells: DataFrame) -> DataFrame:
    """Masked numbers shared by two or more accounts that disagree on status or balance.

    Disagreement is min != max over non-empty texts, which combines map-side, so a
    number shared by very many accounts is never gathered in one task. Only the
    balance cells are read, and no account is paired with another.
    """
    t = with_anchors(tradeline, {"raw_text", "number", "status"}).join(latest_balance(cells), KEY, "left")
    t = t.selectExpr("report_id", "number", "nullif(lower(status), '') AS s",
                     f"{money_state('balance_state')} AS state", "balance_last")
    return (
        t.where("number <> ''").selectExpr("report_id", "number", "s",
                                           "coalesce(nullif(state.value, ''), nullif(balance_last, '')) AS b")
        .groupBy("report_id", "number")
        .agg(F.expr("cast(count(*) AS int) AS n_accounts"),
             F.expr("coalesce(min(s) <> max(s), false) AS status_differs"),
             F.expr("coalesce(min(b) <> max(b), false) AS balance_differs"))
        .where("n_accounts >= 2 AND (status_differs OR balance_differs)")
    )


def status_of(rule: Rule) -> str:
    return (f"CASE WHEN {rule.triggered} THEN 'triggered' WHEN NOT ({rule.applies}) THEN 'not_applicable' "
            f"WHEN {rule.evaluable} THEN 'not_triggered' ELSE 'insufficient_evidence' END")


KEEP = [*KEY, "profile_id", "account_ord", "name", "negative", "source_pages"]


def rule_outcomes(tradeline: DataFrame, cells: DataFrame, ids: list[str] | None = None,
                  keep: list[str] = KEEP) -> DataFrame:
    """Four-state outcome of every (account, rule): one account view, no cross join.

    The statuses are plain columns first and are turned into rows afterwards, which
    keeps the generated code of each step small.
    """
    rules = RULES if ids is None else [BY_ID[i] for i in ids]
    data = account_view(tradeline, cells, names_in(
        sql for r in rules for sql in (r.triggered, r.applies, r.evaluable, r.runs, *keep)) | {"number"})
    if any(r.id == "r01" for r in rules):
        shared = duplicate_conflicts(tradeline, cells).selectExpr("report_id", "number", "true AS duplicate_conflict")
        data = salted_join(data, shared, ["report_id", "number"], "entity_key").fillna(False, ["duplicate_conflict"])
    wide = data.selectExpr(*keep, *[f"{status_of(r)} AS s_{r.id}" for r in rules],
                           *[f"{r.runs} AS f_{r.id}" for r in rules if r.runs != "1"])
    items = ", ".join(
        f"named_struct('rule_id', '{r.id}', 'issue_type', '{r.issue}', 'issue_label', {lit(r.label)}, "
        f"'category', '{r.category}', 'severity', '{r.severity}', 'status', s_{r.id}, "
        f"'n_findings', {'1' if r.runs == '1' else f'f_{r.id}'})"
        for r in rules)
    long = wide.selectExpr(*keep, f"inline(array({items}))")
    return long.withColumn("n_findings", F.expr("if(status = 'triggered', n_findings, 0)"))
