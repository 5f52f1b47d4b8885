"""Validation and quality: checks become issue rows, issues become statuses and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions.classify import section_present
from tradeglass.functions.text import lit, one_of

# --- fixed values: components a layout must complete ---------------------------------
REQUIRED = {
    "equifax_old_v1": ["reportConfirmationDetails", "personalInformation", "summary", "creditAccountsSummary",
                       "otherItemsSummary", "accounts", "collections", "inquiries"],
    "equifax_new_v1": ["reportConfirmationDetails", "summary", "personalInformation", "accounts", "inquiries"],
    "experian_acr_v1": ["reportOverview", "personalInformation", "accounts", "publicRecords", "hardInquiries", "softInquiries"],
    "transunion_acr_v1": ["reportOverview", "personalInformation", "adverseAccounts", "satisfactoryAccounts", "inquiries",
                          "accountReviewInquiries"],
}
#: Layouts that verification holds to their own list; every other one is held to the first layout's.
VERIFIED_BY_OWN_LIST = ["equifax_new_v1"]


def is_required(layouts: list[str]) -> str:
    """Whether a component is required, by the list of its layout where that is one of these, else by the first list."""
    cases = " ".join(f"WHEN '{p}' THEN {one_of('component', REQUIRED[p])}" for p in layouts)
    return f"CASE profile_id {cases} ELSE {one_of('component', REQUIRED['equifax_old_v1'])} END"


def field_issues(rows: DataFrame, key: list[str], checks: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Issue rows of predicates: code -> (component, severity, SQL test that must not hold)."""
    items = ", ".join(
        f"if({test}, named_struct('component', '{component}', 'severity', '{severity}', 'code', '{code}'), NULL)"
        for code, (component, severity, test) in checks.items())
    return rows.selectExpr(*key, f"inline(array_compact(array({items})))")


def count_mismatches(stated: DataFrame, extracted: DataFrame) -> DataFrame:
    """Stated against extracted counts per (report, component); a stated total counts only when it says something.

    Account totals are enforced only where the summary tells open from total.
    """
    both = stated.join(extracted, ["report_id", "component"], "left")
    enforced = ("stated > 0 AND (component <> 'accounts' OR n_closed IS NOT NULL OR (n_open IS NOT NULL AND stated <> n_open))")
    return both.selectExpr("report_id", "component", "stated", "cast(coalesce(extracted, 0) AS int) AS extracted",
                           f"NOT coalesce({enforced}, false) OR stated = coalesce(extracted, 0) AS pass")


def component_status(components: DataFrame, issues: DataFrame) -> DataFrame:
    """A component fails on any error or critical issue."""
    failed = issues.where("severity IN ('error', 'critical')").select("report_id", "component").distinct()
    return components.join(failed.withColumn("bad", F.lit(True)), ["report_id", "component"], "left").selectExpr(
        "report_id", "profile_id", "component", "if(bad, 'failed', 'complete') AS status")


def readiness(statuses: DataFrame) -> DataFrame:
    """A report is ready when every component its layout requires is complete."""
    n = "CASE profile_id " + " ".join(f"WHEN '{p}' THEN {len(c)}" for p, c in REQUIRED.items()) + f" ELSE {len(REQUIRED['equifax_old_v1'])} END"
    return statuses.groupBy("report_id", "profile_id").agg(
        F.expr(f"count(DISTINCT if({is_required(list(REQUIRED))} AND status = 'complete', component, NULL)) AS done")).selectExpr(
        "report_id", "profile_id", f"done = {n} AS ready")


def match_rates(grounded: DataFrame) -> DataFrame:
    """Matched share per component and overall (component null), four decimals."""
    return grounded.rollup("component").agg(
        F.count("*").cast("int").alias("total"), F.expr("cast(count_if(n_pages > 0) AS int) AS matched"),
        F.expr("round(avg(if(n_pages > 0, 1.0D, 0.0D)), 4) AS match_rate"))


def contact_issues(accounts: DataFrame) -> DataFrame:
    """All accounts of a report without contact data is critical, some is a warning."""
    totals = accounts.groupBy("report_id").agg(F.expr(
        "cast(count_if(trim(coalesce(address, '')) = '' AND trim(coalesce(phone, '')) = '') AS int) AS n_missing"),
        F.count("*").cast("int").alias("n_accounts"))
    return totals.where("n_missing > 0").selectExpr(
        "report_id", "'missing_contact_information' AS code", "if(n_missing = n_accounts, 'critical', 'warning') AS severity", "n_missing")


def verified_ready(reports: DataFrame, statuses: DataFrame, checks: DataFrame, issues: DataFrame, fixtures: DataFrame) -> DataFrame:
    """No required component failed, every count and fixture check passes, and no blocking quality issue."""
    bad = (
        statuses.where(f"status = 'failed' AND {is_required(VERIFIED_BY_OWN_LIST)}").select("report_id")
        .unionByName(fixtures.where("NOT pass").select("report_id"))
        .unionByName(checks.where("NOT pass").select("report_id"))
        .unionByName(issues.where("severity IN ('critical', 'error')").select("report_id")).distinct()
    )
    return reports.select("report_id").join(bad.withColumn("bad", F.lit(True)), "report_id", "left").selectExpr(
        "report_id", "bad IS NULL AS verified")


def fixture_checks(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Expected values against actual ones; a side that is absent fails the check."""
    return expected.join(actual, key, "full").selectExpr(
        *key, "expected", "actual", "coalesce(expected = actual, false) AS pass")


def section_gaps(documents: DataFrame) -> DataFrame:
    """Sections found in a document that its layout does not cover. documents: doc_id, profile_id, body."""
    found = ", ".join(f"named_struct('section', '{s}', 'present', {section_present('body', s)})" for s in vocab.SECTION_PATTERNS)
    long = documents.selectExpr("doc_id", "profile_id", f"inline(array({found}))").where("present")
    covered = " OR ".join(f"(profile_id = '{p}' AND {one_of('section', c)})" for p, c in vocab.LAYOUT_COVERAGE.items())
    return long.where(f"NOT ({covered})").select("doc_id", "profile_id", "section")


def layout_summary(accounts: DataFrame, issues: DataFrame) -> DataFrame:
    """Accounts, issues and mortgage-like accounts per report."""
    a = accounts.groupBy("report_id", "profile_id").agg(
        F.count("*").cast("int").alias("n_accounts"),
        F.expr("cast(count_if(lower(type) RLIKE 'mortgage|home|real estate') AS int) AS n_mortgage"))
    i = issues.groupBy("report_id").agg(F.count("*").cast("int").alias("n_issues"))
    return a.join(i, "report_id", "left").fillna(0, ["n_issues"])


def evidence_coverage(citations: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Per finding: uncited items, duplicate rectangles, boxes off their page, point/pixel disagreement above 2.5 px."""
    cited = citations.join(boxes.select("finding_id", "item").distinct().withColumn("boxed", F.lit(True)),
                           ["finding_id", "item"], "left").groupBy("finding_id").agg(
        F.expr("cast(count_if(boxed IS NULL) AS int) AS n_uncovered"))
    rects = boxes.groupBy("finding_id", "page", "x", "y", "width", "height").agg(F.count("*").alias("n"))
    dup = rects.where("n > 1").groupBy("finding_id").agg(F.count("*").cast("int").alias("n_duplicate_rects"))
    far = " OR ".join(f"abs(point_{c} * 2 - {c}) > 2.5" for c in ("x", "y"))
    placed = boxes.join(pages, ["doc_id", "page"], "left").groupBy("finding_id").agg(
        F.expr("cast(count_if(page_width IS NULL OR x + width > page_width OR y + height > page_height) AS int) AS n_off_page"),
        F.expr(f"cast(count_if({far}) AS int) AS n_geometry"))
    out = cited.join(dup, "finding_id", "full").join(placed, "finding_id", "full")
    return out.fillna(0, ["n_uncovered", "n_duplicate_rects", "n_off_page", "n_geometry"])


def certification(bundles: DataFrame) -> DataFrame:
    """Per layout: reports, findings, exportable and unresolved bundles, and bundles per resolution mode."""
    per_mode = bundles.groupBy("profile_id", "mode").agg(
        F.count("*").alias("n"), F.expr("count_if(status = 'ready' AND mode = 'quality') AS e"),
        F.expr("count_if(status <> 'ready') AS u"))
    reports = bundles.groupBy("profile_id").agg(F.countDistinct("report_id").cast("int").alias("n_reports"))
    return per_mode.groupBy("profile_id").agg(
        F.expr("cast(sum(n) AS int) AS n_findings"), F.expr("cast(sum(e) AS int) AS n_exportable"),
        F.expr("cast(sum(u) AS int) AS n_unresolved"),
        F.expr("map_from_entries(array_sort(collect_list(struct(mode, cast(n AS int))))) AS modes")).join(reports, "profile_id")


# --- fixed values: labels a bundle of an issue must show ------------------------------
REQUIRED_LABELS = {
    "payment_history_missing_months": [
        ("missing_slot_proof_not_shown", ["Missing payment-history month"]),
        ("gap_boundary_not_shown", ["Older reported payment-history month", "Newer reported payment-history month"])],
    "recent_payment_missing_when_history_implies_payment": [
        ("recent_payment_field_not_shown", ["Reported recent payment field"]),
        ("recent_current_month_not_shown", ["Latest current payment-history month"])],
    "delinquency_progression_inconsistency": [
        ("earlier_delinquency_month_not_shown", ["Earlier delinquency month"]),
        ("later_delinquency_month_not_shown", ["Later delinquency month"])],
    "retroactive_derogatory_backfill_after_reporting_gap": [
        ("missing_slot_proof_not_shown", ["Blank reporting-gap month"]),
        ("later_derogatory_month_not_shown", ["Later derogatory month after the gap"]),
        ("earlier_boundary_month_not_shown", ["Earlier reported month before the gap"])],
}


def structural_problems(boxes: DataFrame) -> DataFrame:
    """Problems of a bundle: required labels it does not show, and oversized crops.

    boxes: finding_id, issue_type, slide, label, crop_share (crop area over page area).
    """
    labels = boxes.groupBy("finding_id", "issue_type").agg(F.expr("collect_set(label) AS labels"))
    tests = ", ".join(
        f"if(issue_type = '{issue}' AND NOT arrays_overlap(labels, array({', '.join(lit(x) for x in wanted)})), '{problem}', NULL)"
        for issue, rules in REQUIRED_LABELS.items() for problem, wanted in rules)
    missing = labels.selectExpr("finding_id", f"explode(array_compact(array({tests}))) AS problem")
    slides = boxes.groupBy("finding_id", "issue_type", "slide").agg(
        F.max("crop_share").alias("share"), F.count("*").alias("n"))
    large = slides.where(f"{one_of('issue_type', list(REQUIRED_LABELS))} AND (share > 0.28 OR n > 6)").selectExpr(
        "finding_id", "'oversized_crop' AS problem").distinct()
    return missing.unionByName(large)
