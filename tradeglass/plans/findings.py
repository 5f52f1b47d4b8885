"""Findings: selection defaults, merging, ranking, grouping and rollups of rule outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions.dates import month_label
from tradeglass.functions.text import add, lookup, names_in, norm_text, one_of
from tradeglass.operators.history import KEY
from tradeglass.operators.skew import grouped_rank, salted_join

CATEGORY_ORDER = {c: i for i, c in enumerate(vocab.CATALOG_CATEGORY_ORDER)}


def with_selection(findings: DataFrame) -> DataFrame:
    """selected and selection_basis of findings: explicit choice, escalation, demotion, category, posture.

    findings: entity_type, issue_type, category, negative (null for unknown), and
    explicit (boolean or null).
    """
    negative = "coalesce(negative, true)"
    basis = (f"CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN {one_of('issue_type', vocab.ESCALATED_ISSUES)} THEN 'attorney_escalation' "
             f"WHEN {one_of('issue_type', list(vocab.DEMOTED_ISSUES))} THEN 'strategy_demoted' "
             f"WHEN entity_type <> 'account' THEN 'non_account_default' WHEN category = 'legal_public_record' THEN 'explicit' "
             f"WHEN {negative} THEN 'negative_account' ELSE 'positive_account' END")
    return add(add(findings, {"selection_basis": basis}), {
        "selected": "coalesce(explicit, selection_basis NOT IN ('strategy_demoted', 'positive_account'))"})


#: The layout that prints adverse accounts in a section of their own.
ADVERSE_LAYOUT = "transunion_acr_v1"


def with_posture(accounts: DataFrame, adverse: DataFrame) -> DataFrame:
    """accounts (report_id, profile_id, negative, source_pages) with posture: negative by fields or, in one layout, by standing on an adverse page.

    adverse: report_id, adverse_pages, one row per report.
    """
    joined = salted_join(accounts, adverse, ["report_id"], "entity_key")
    on_adverse = f"profile_id = '{ADVERSE_LAYOUT}' AND coalesce(arrays_overlap(filter(source_pages, p -> p > 0), adverse_pages), false)"
    return add(joined, {"posture": f"if(coalesce(negative, false) OR ({on_adverse}), 'negative', 'positive')"}).drop("adverse_pages")


def account_findings(outcomes: DataFrame, adverse: DataFrame | None = None) -> DataFrame:
    """Triggered outcomes as findings with an id and their defaults, which go by posture where adverse pages are given."""
    chosen = outcomes.where("status = 'triggered'")
    if adverse is not None:
        chosen = with_posture(chosen, adverse).withColumn("negative", F.col("posture") == "negative")
    rows = chosen.selectExpr(
        *KEY, "'account' AS entity_type", "rule_id", "issue_type", "category", "severity", "negative",
        "cast(NULL AS boolean) AS explicit", "concat(issue_type, ':', entity_key) AS finding_id")
    return with_selection(rows)


def merge_findings(findings: DataFrame) -> DataFrame:
    """One row per (account, issue): top severity, all unique facts by ordinal, all fields.

    Facts that repeat are folded before they are collected, so a group is bounded by the distinct facts
    of one account; fields are distinct names of a fixed vocabulary.
    """
    key = [*KEY, "issue_type"]
    top = add(findings, {"severity_rank": lookup("severity", vocab.SEVERITY_ORDER)}).groupBy(*key).agg(
        F.min("severity_rank").alias("severity_rank"), F.count("*").cast("int").alias("n_findings"),
        F.expr("array_sort(collect_set(field)) AS fields"))
    unique = findings.groupBy(*key, F.expr("lower(fact)").alias("fact_key")).agg(
        F.expr("min(struct(ord, fact)) AS first"))
    facts = unique.groupBy(*key).agg(F.expr("transform(array_sort(collect_list(first)), x -> x.fact) AS facts"))
    return top.join(facts, key, "left")


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Rank within the report by severity, category and id; a large report is ranked across many tasks."""
    order = add(findings, {"severity_rank": lookup("severity", vocab.SEVERITY_ORDER),
                           "category_rank": lookup("category", vocab.CATEGORY_RANK)})
    return grouped_rank(order, ["report_id"], ["severity_rank", "category_rank", "finding_id"])


def catalog_order(outcomes: DataFrame) -> DataFrame:
    """Position of every rule in an account's catalogue; an account has one row per rule."""
    order = add(outcomes, {"c_rank": lookup("category", CATEGORY_ORDER), "s_rank": lookup("status", vocab.STATUS_ORDER)})
    w = Window.partitionBy(*KEY).orderBy("c_rank", "s_rank", "issue_label")
    return order.withColumn("position", F.row_number().over(w)).drop("c_rank", "s_rank")


def with_manual(findings: DataFrame, manual: DataFrame) -> DataFrame:
    """Add complete, selected manual findings."""
    complete = manual.where(f"selected AND {norm_text('summary')} <> '' AND {norm_text('label')} <> ''").selectExpr(
        *KEY, "concat('manual:', entity_key, ':', ord) AS finding_id", "'manual' AS issue_type")
    return findings.select(*KEY, "finding_id", "issue_type").unionByName(complete)


def with_review_fallback(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """A review request for every report without a selected finding."""
    covered = findings.where("selected").select("report_id").distinct()
    return reports.join(covered, "report_id", "left_anti").selectExpr(
        "report_id", "concat('report-review:', report_id) AS finding_id", "'report_review_request' AS issue_type")


def display_months(months: DataFrame, key: list[str]) -> DataFrame:
    """All months of a conflict with their position from either end, for a caller to cut a display by."""
    w = Window.partitionBy(*key).orderBy("m")
    n = F.count("*").over(Window.partitionBy(*key))
    return months.withColumn("position", F.row_number().over(w).cast("long")).withColumn("from_end", n - F.col("position") + 1)


def dispute_groups(findings: DataFrame) -> DataFrame:
    """Selected findings per entity, entities numbered in the order of their best finding."""
    chosen = ranked_findings(findings.where("selected"))
    groups = chosen.groupBy(*KEY).agg(F.count("*").cast("int").alias("n_findings"), F.min("rank").alias("first_rank"))
    return grouped_rank(groups, ["report_id"], ["first_rank"], "group_no")


# --- fixed values: what is shown beside a rule, by label; a rule without an entry shows the last list -------
MONTHS_REVIEWED = [("Months reviewed", "months_reviewed")]
STATUS_AND_COMMENTS = [("Status", "status"), ("Comments", "comments_shown")]
BALANCE_AND_PAYMENT = [("Current balance", "balance"), ("Payment amount", "payment_amount")]
CREDITOR_AND_TYPE = [("Original creditor", "original_creditor"), ("Account type", "type")]
DELINQUENCY_DATES = [("Date of first delinquency", "first_delinquency"), ("Estimated removal", "removal")]
BALANCE_FIELD = ("Reported current balance field", "balance_shown")
OBSERVED: dict[str, list[tuple[str, str]]] = {
    "r01": [("Account number", "number"), ("Status", "status"), ("Balance", "balance")],
    "r02": [("Account number", "number")],
    "r03": [("Furnisher address", "address"), ("Furnisher phone", "phone")],
    "r04": [("Status", "status"), ("Amount past due", "past_due"), ("Charge-off amount", "charge_off")],
    "r05": CREDITOR_AND_TYPE, "r06": CREDITOR_AND_TYPE,
    "r07": [("Responsibility", "responsibility")],
    "r08": [("Status", "status"), ("Comments", "comments_shown"), ("Additional information", "additional"), ("Consumer statement", "statement"),
            ("Reinvestigation info", "reinvestigation"), ("Legal category", "legal_category")],
    **{r: MONTHS_REVIEWED for r in ("r09", "r10", "r11", "r17", "r20", "r22", "r23", "r24", "r25", "r26", "r27", "r28")},
    "r13": [("Date opened", "date_opened"), ("Months reviewed", "months_reviewed")],
    "r14": [("Account type", "type"), ("Monthly payment", "payment_amount"), ("Terms", "terms_shown")],
    "r15": [("Last payment date", "last_payment"), ("Recent payment", "recent_payment")],
    **{r: [("Amount past due", "past_due")] for r in ("r16", "r18", "r19")},
    "r21": [("Reported last payment date", "last_payment"), ("Recent payment", "recent_payment"), ("Reported date", "date_reported"),
            ("Status-updated date", "status_updated"), ("Balance-updated date", "balance_updated")],
    "r29": STATUS_AND_COMMENTS, "r30": STATUS_AND_COMMENTS, "r44": STATUS_AND_COMMENTS, "r45": STATUS_AND_COMMENTS,
    "r31": [("Last payment date", "last_payment"), ("Recent payment", "recent_payment"), ("Scheduled payment", "scheduled_shown")],
    "r32": [("Current balance", "balance"), ("Monthly payment", "payment_amount")],
    "r33": [("Reported last payment date field", "stated_last_payment"), ("Reported scheduled payment amount field", "scheduled_shown")],
    "r34": [("Reported last payment date field", "stated_last_payment"), ("Reported recent/actual payment amount field", "payment_shown")],
    "r35": [("Reported scheduled payment amount field", "scheduled_shown"), ("Reported terms field", "terms"), ("Reported term duration field", "duration")],
    "r36": [("Closure timing", "closure_timing"), ("Closure month", "closure_month"), ("Closure-month payment history", "closure_status_shown"),
            ("Closure-month actual payment table", "closure_paid_shown"), ("Scalar last-payment signal", "signal_shown")],
    "r37": [("Closure timing", "closure_timing"), ("Closure month", "closure_month"), ("Scalar actual payment signal", "signal_shown"),
            ("Closure-month actual payment table", "closure_paid_shown")],
    "r38": [("High balance", "high_balance"), ("Current balance", "balance")],
    "r39": BALANCE_AND_PAYMENT, "r40": BALANCE_AND_PAYMENT, "r43": BALANCE_AND_PAYMENT,
    "r41": [("Credit limit", "credit_limit")],
    "r42": [("Current balance field", "balance_shown"), ("Status", "status"), ("Amount past due", "past_due"), ("Charge-off amount", "charge_off")],
    "r46": DELINQUENCY_DATES, "r49": DELINQUENCY_DATES,
    "r47": [("Status-updated date", "status_updated")], "r52": [("Status-updated date", "status_updated")],
    "r48": [BALANCE_FIELD, ("Balance-updated date", "balance_updated")], "r53": [BALANCE_FIELD, ("Balance-updated date", "balance_updated")],
    "r50": [("Reported closed date", "date_closed"), ("Reported status-updated date", "status_updated"), ("Reported balance-updated date", "balance_updated"), ("Reported status", "status")],
    "r51": [BALANCE_FIELD, ("Reported date", "date_reported")],
}
OTHERWISE = [("Status", "status"), ("Balance", "balance")]
#: What is shown where no column of the account view says it as it is.
SHOWN = {
    "comments_shown": "array_join(comments, '; ')",
    "terms_shown": "coalesce(nullif(duration, ''), terms)",
    "balance_shown": "if(balance_state.state = 'missing_field', 'Missing', balance_state.value)",
    "scheduled_shown": "scheduled_state.value",
    "payment_shown": "payment_state.value",
    "closure_month": f"if(is_closed, {month_label('closure_m')}, '')",
    "closure_status_shown": "if(is_closed, closure_status, '')",
    "closure_paid_shown": "if(is_closed, closure_paid, '')",
    "signal_shown": "if(payment_reported, payment_state.value, stated_last_payment)",
}


def observed_columns() -> set[str]:
    """Columns of the account view that the observed values read."""
    columns = {c for shown in [*OBSERVED.values(), OTHERWISE] for _, c in shown}
    return (columns - set(SHOWN)) | names_in(SHOWN[c] for c in columns & set(SHOWN))


def observed_facts(view: DataFrame, rules: list[str]) -> DataFrame:
    """(account, rule, label, value) of what each rule looked at, whether it fired or not; empty values read 'Not reported'."""
    rows = ", ".join(f"named_struct('rule_id', '{r}', 'label', '{label}', 'value', coalesce(nullif({SHOWN.get(c, c)}, ''), 'Not reported'))"
                     for r in rules for label, c in OBSERVED.get(r, OTHERWISE))
    return view.selectExpr(*KEY, f"inline(array({rows}))")


def rollup_findings(findings: DataFrame) -> DataFrame:
    """Findings per issue, severity, layout and their totals."""
    return findings.cube("profile_id", "severity", "issue_type").agg(F.count("*").cast("int").alias("n_findings"))


def evidence_refs(conflicts: DataFrame) -> DataFrame:
    """Cells a conflict cites: the month itself, its boundary month, and the gap months between."""
    rows = ("concat(array(named_struct('role', 'conflict', 'ref_m', m)), "
            "if(prev_m IS NULL, array(), array(named_struct('role', 'boundary', 'ref_m', prev_m))), "
            "if(kind IN ('blank_gap', 'backfill') AND m - prev_m > 1, "
            "transform(sequence(prev_m + 1, m - 1), x -> named_struct('role', 'gap', 'ref_m', x)), array()))")
    return conflicts.selectExpr(*KEY, "kind", f"inline({rows})").distinct()
