"""Whole payloads: components, leaves, checks and nested merges against plain readings of small JSON texts."""

import json
import random
import re
from collections import Counter

import pytest

from tradeglass.sources import checks, merge
from tradeglass.sources import components as c


def found(spark, *bodies):
    return c.payloads(spark.createDataFrame([(b if isinstance(b, str) or b is None else json.dumps(b),) for b in bodies], "value string"))


def body(profile, components, **meta):
    return {"result": {"meta": {"sessionId": "s", "profileId": profile, **meta}, "components": components}}


def test_payloads_are_told_from_other_texts(spark):
    lines = ["", "{bad", "[1]", "7", None, '{"result": "text"}', '{"other": 1}', {"result": {"components": {}}}, {"components": {"x": 1}, "meta": {"sessionId": "q"}}, {"result": {"profile": "equifax_new_v1"}, "sessionId": 5}]
    rows = found(spark, *lines).collect()
    assert sorted((r.report_id or "", r.profile_id) for r in rows) == [("", c.OLD), ("5", "equifax_new_v1"), ("q", c.OLD)]


def scalars(value, path, out):
    """The leaves worth grounding, by recursion over parsed JSON."""
    if isinstance(value, dict):
        if path.split(".")[-1] in c.SKIPPED_SUBTREES:
            return
        for k, v in value.items():
            scalars(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            scalars(v, f"{path}[{i}]", out)
    elif isinstance(value, str):
        low = re.sub(r"\s+", " ", value).strip().lower()
        short = re.fullmatch(r"[\d,\.%$]+", low) and len(re.sub(r"\D", "", low)) <= 3
        if low not in c.UNGROUNDED_TEXTS and not short and path.split(".")[-1].split("[")[0] not in c.SKIPPED_LEAVES:
            out.append((path, re.match(r"components\.([a-zA-Z_]+)", path)[1], value))


def nested(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < .35:
        return rnd.choice(["text", " Not  reported ", "", "12%", "1,234", "None", "a b", 5, 2.5, True, None, "$99"])
    if kind < .6:
        return [nested(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {k: nested(rnd, depth - 1) for k in rnd.sample(["alpha", "beta", "paymentStatusCodes", "inquiries", "collectionFields", "totalAccounts", "x_y"], rnd.randint(0, 4))}


def test_leaves_of_any_depth(spark):
    rnd = random.Random(1)
    trees = [{"part": nested(rnd, d % 8)} for d in range(40)] + [{}, {"part": {"paymentStatusCodes": {"OK": "Pays"}, "list": {"paymentStatusCodes": ["kept text"]}}}]
    want = Counter()
    for i, t in enumerate(trees):
        out = []
        scalars(t, "components", out)
        want.update((f"r{i}", *x) for x in out)
    rows = found(spark, *({"result": {"components": t, "meta": {"sessionId": f"r{i}"}}} for i, t in enumerate(trees)))
    assert Counter(map(tuple, c.flatten(rows).collect())) == want and any(p.count(".") + p.count("[") >= 6 for _, p, _, _ in want)
    assert c.flatten(rows.limit(0)).count() == 0


def test_accounts_of_every_layout(spark):
    old = body("equifax_old_v1", {"accounts": {"accounts": [{"accountName": "A  b", "accountNumber": "1 2", "status": None, "balance": "$5", "comments": "x; Y|z", "codes": {"k": {"deep": 1}}}, "junk"]}},
               accountSources=[{"accountName": "a B", "accountNumber": "1  2", "pages": [0, 4, 4, "x", 7]}], componentSources={"accounts": [9]})
    exp = body("experian_acr_v1", {"accounts": {"accounts": [{"header": {"accountName": "Head", "isClosed": True}, "accountInfo": {"accountName": "not reported", "accountNumber": "77", "comments": ["one", " ONE "]},
                                                               "comments": "two", "sourcePages": [3]}]}})
    new = body("equifax_new_v1", {"accounts": {"accounts": [{"accountName": "N", "narrativeCodes": [{"description": "said"}, {"code": 1}], "address": "St", "phoneNumber": ""}]}})
    tru = body("transunion_acr_v1", {"satisfactoryAccounts": {"accounts": [{"accountInfo": {"accountName": "S", "remarks": "Not reported"}}]}, "adverseAccounts": {"accounts": [{"accountName": "V", "accountInfo": {"remarks": "late"}}]}})
    rows = {(r.profile_id, r.account_ord): r for r in c.tradelines(found(spark, old, exp, new, tru)).collect()}
    a = rows["equifax_old_v1", 0]
    assert (a.entity_key, a.source_pages, a.comments) == ("a b::1 2", [4, 7], ["x", "Y", "z"])
    assert a.raw == {"accountName": "A  b", "accountNumber": "1 2", "status": None, "balance": "$5", "comments": "x; Y|z"}
    assert rows["equifax_old_v1", 1].account_name == "Not reported" and rows["equifax_old_v1", 1].source_pages == [9] and rows["equifax_old_v1", 1].raw == {}
    e = rows["experian_acr_v1", 0]
    assert (e.account_name, e.account_number, e.comments, e.closed_flag, e.source_pages) == ("Head", "77", ["one", "two"], True, [3])
    assert rows["equifax_new_v1", 0].comments == ["said"] and rows["equifax_new_v1", 0].contact == ["St"]
    assert [rows["transunion_acr_v1", i].account_name for i in (0, 1)] == ["V", "S"] and rows["transunion_acr_v1", 0].comments == ["late"] and rows["transunion_acr_v1", 1].comments == []


def test_evidence_of_months_and_inquiries(spark):
    cell = lambda v, p: {"value": v, "pageNumber": p}
    b = body("equifax_old_v1", {"accounts": {"accounts": [{}, {"month24History": {"sections": [{"key": "other"}, {"key": " balance "}]}}]}, "inquiries": {"hardInquiries": [{"purpose": "loan"}]}},
             accountHistoryEvidence=[{"fields": {"paymentHistory": [{"months": {"jan": cell("OK", 3)}}, {"months": {"dec": cell("30", 4), "feb": cell("60", 0), "note": None}}]}},
                                     {"fields": {"month24:balance": [{"months": {"mar": cell("$5", 6)}}], "balanceHistory": [{"months": {"apr": cell("$9", 7)}}]}}],
             inquiryEvidence={"hardInquiries": [{"subscriberName": "Bank", "pages": [2, -1, 2]}]})
    a = "components.accounts.accounts"
    assert sorted((r.path, r.value, r.page) for r in c.history_evidence(found(spark, b)).collect()) == sorted([
        (f"{a}[0].paymentHistory[0]", "OK", 3), (f"{a}[0].paymentHistory[0].jan", "OK", 3), (f"{a}[0].paymentHistory[23]", "30", 4), (f"{a}[0].paymentHistory[1].dec", "30", 4),
        (f"{a}[1].month24History.sections[1].rows[0].mar", "$5", 6), (f"{a}[1].balanceHistory[0].apr", "$9", 7)])
    h = "components.inquiries.hardInquiries[0]"
    assert sorted((r.path, r.value, r.page) for r in c.inquiry_evidence(found(spark, b)).collect()) == [(f"{h}.purpose", "loan", 2), (f"{h}.subscriberName", "Bank", 2)]


GOOD_SUMMARY = [{"accountType": t, "totalAccounts": str(i + 1), "withBalance": "1", "open": "5" if t == "Total" else "1"} for i, t in enumerate(["Revolving", "Mortgage", "Installment", "Other", "Total"])]


def good():
    history = [{"year": "2020"}]
    account = {"accountName": "A", "status": "Current", "openDate": "01/02/2003", "contact": ["PO Box"], "paymentHistory": ["OK"] * 12, **{h: history for h in checks.HISTORIES}}
    return {"reportConfirmationDetails": {"confirmationNumber": "1", "reportDate": "x"}, "personalInformation": {"name": "P"}, "summary": {"accountsWithNegativeInfo": 0, "oldestAccount": {"openDate": "Mar 1, 1999"}},
            "creditAccountsSummary": [dict(r) for r in GOOD_SUMMARY], "accounts": {"accounts": [account]}, "publicRecords": {"records": []}, "collections": {"collections": [{"collectionAgency": "C"}]},
            "inquiries": {"hardInquiries": [{}], "softInquiries": [], "hardInquiryCount": 1}, "otherItemsSummary": {"inquiryCount": 1, "collectionCount": 1, "publicRecordCount": 0}}


def issues(df):
    return sorted((r.code, r.severity, r.path) for r in df.collect())


def test_a_sound_payload_has_no_issue(spark):
    rows = found(spark, body("equifax_old_v1", good()))
    assert issues(checks.validation_issues(rows)) == issues(checks.count_issues(rows)) == issues(checks.quality_issues(rows)) == []


ACC, COL = "components.accounts.accounts", "components.collections.collections"
BREAKS = [
    (lambda g: g["reportConfirmationDetails"].update(confirmationNumber=""), "v", ("missing_confirmation_number", "error", "components.reportConfirmationDetails.confirmationNumber")),
    (lambda g: g["reportConfirmationDetails"].update(reportDate=None), "v", ("missing_report_date", "error", "components.reportConfirmationDetails.reportDate")),
    (lambda g: g.pop("personalInformation"), "v", ("missing_personal_name", "error", "components.personalInformation.name")),
    (lambda g: g.update(creditAccountsSummary={}), "v", ("invalid_summary_schema", "error", "components.creditAccountsSummary")),
    (lambda g: g["creditAccountsSummary"].pop(), "v", ("invalid_row_count", "error", "components.creditAccountsSummary")),
    (lambda g: g["creditAccountsSummary"].reverse(), "v", ("invalid_row_order", "error", "components.creditAccountsSummary[0].accountType")),
    (lambda g: g.update(accounts={"accounts": "none"}), "v", ("invalid_accounts_schema", "error", ACC)),
    (lambda g: g["accounts"]["accounts"].append("junk"), "v", ("invalid_account_entry", "error", f"{ACC}[1]")),
    (lambda g: g["accounts"]["accounts"][0].update(balanceHistory=[1, 2, 3, 4]), "v", ("invalid_history_rows", "error", f"{ACC}[0].balanceHistory")),
    (lambda g: g["accounts"]["accounts"][0].update(paymentHistory=["OK"] * 13), "v", ("invalid_payment_history_length", "error", f"{ACC}[0].paymentHistory")),
    (lambda g: g["publicRecords"].pop("records"), "v", ("invalid_public_records_schema", "error", "components.publicRecords.records")),
    (lambda g: g.update(collections=[]), "v", ("invalid_collections_list", "error", COL)),
    (lambda g: g["inquiries"].pop("softInquiries"), "v", ("invalid_inquiry_lists", "error", "components.inquiries")),
    (lambda g: g["creditAccountsSummary"][4].update(totalAccounts="9", open="3"), "c", ("cross_component_mismatch", "error", "components.accounts")),
    (lambda g: g["otherItemsSummary"].update(collectionCount=4), "c", ("cross_component_mismatch", "error", "components.collections")),
    (lambda g: g["otherItemsSummary"].update(publicRecordCount=4), "c", ("cross_component_mismatch", "error", "components.publicRecords")),
    (lambda g: g["inquiries"].update(softInquiryCount=1), "c", ("cross_component_mismatch", "error", "components.inquiries")),
    (lambda g: g["summary"].pop("accountsWithNegativeInfo"), "q", ("required_field_missing", "error", "components.summary.accountsWithNegativeInfo")),
    (lambda g: g["summary"].update(recentAccount={"openDate": "1999"}), "q", ("invalid_date", "error", "components.summary.recentAccount.openDate")),
    (lambda g: g["creditAccountsSummary"][2].update(withBalance="40"), "q", ("count_logic_error", "error", "components.creditAccountsSummary[2].withBalance")),
    (lambda g: [r.update(totalAccounts="1") for r in g["creditAccountsSummary"]], "q", ("duplicated_rows", "critical", "components.creditAccountsSummary")),
    (lambda g: g["accounts"].update(accounts=[]), "q", ("empty_accounts", "critical", ACC)),
    (lambda g: g["accounts"]["accounts"][0].update(accountName="Collections stay on your report"), "q", ("contaminated_value", "error", f"{ACC}[0].accountName")),
    (lambda g: g["accounts"]["accounts"][0].update(status="Open Available  Credit"), "q", ("contaminated_value", "error", f"{ACC}[0].status")),
    (lambda g: g["accounts"]["accounts"][0].update(loanType="Date Closed"), "q", ("contaminated_value", "error", f"{ACC}[0].loanType")),
    (lambda g: g["accounts"]["accounts"][0].update(comments=["fine", "Comments | Contact"]), "q", ("contaminated_value", "critical", f"{ACC}[0].comments[1]")),
    (lambda g: g["accounts"]["accounts"][0].update(contact="CONTACT"), "q", ("contaminated_value", "critical", f"{ACC}[0].contact[0]")),
    (lambda g: g["accounts"]["accounts"][0].update(openDate="None"), "q", ("missing_key_dates", "error", f"{ACC}[*].openDate")),
    (lambda g: g["accounts"]["accounts"][0].update(contact=[" "]), "q", ("missing_contact_information", "critical", f"{ACC}[*].contact")),
    (lambda g: g["accounts"]["accounts"].append({"openDate": "x", "contact": []}), "q", ("missing_contact_information", "warning", f"{ACC}[*].contact")),
    (lambda g: g["collections"]["collections"].append({}), "q", ("missing_required_fields", "error", f"{COL}[*].collectionAgency")),
    (lambda g: g["collections"]["collections"][0].update(collectionAgency="Page 7"), "q", ("contaminated_value", "error", f"{COL}[0].collectionAgency")),
    (lambda g: g["collections"]["collections"][0].update(status="Date of first delinquency"), "q", ("contaminated_value", "error", f"{COL}[0].status")),
    (lambda g: g["inquiries"].update(hardInquiries=[]), "q", ("count_mismatch", "critical", "components.inquiries")),
]


def test_every_code_is_emitted_by_its_own_fault(spark):
    bodies = []
    for i, (spoil, _, _) in enumerate(BREAKS):
        g = good()
        spoil(g)
        bodies.append(body("equifax_old_v1", g, sessionId=f"{i}"))
    rows = found(spark, *bodies)
    got = {k: {} for k in "vcq"}
    for k, check in (("v", checks.validation_issues), ("c", checks.count_issues), ("q", checks.quality_issues)):
        for r in check(rows).collect():
            got[k].setdefault(r.report_id, set()).add((r.code, r.severity, r.path))
    for i, (_, k, want) in enumerate(BREAKS):
        assert want in got[k].get(str(i), set()), (i, want, got[k].get(str(i)))


def test_quality_of_the_layout_with_checks_of_its_own(spark):
    silent = {"address": " ", "paymentHistory": []}
    b = body("equifax_new_v1", {"reportConfirmationDetails": {"confirmationNumber": "1"}, "accounts": {"accounts": [silent, dict(silent)]}}, sessionId="a")
    b["result"]["componentStatus"] = {"summary": {"status": "failed"}, "accounts": "complete"}
    part = body("equifax_new_v1", {"reportConfirmationDetails": {"confirmationNumber": "1", "reportDate": "d"}, "accounts": {"accounts": [silent, {"phoneNumber": "5", "paymentHistory": [{"year": "2020"}]}]}}, sessionId="b")
    rows = checks.quality_issues(found(spark, b, part)).collect()
    assert sorted((r.report_id, r.code, r.severity) for r in rows) == [("a", "component_failed", "error"), ("a", "missing_contact_information", "critical"), ("a", "missing_payment_history", "critical"),
                                                                       ("a", "required_field_missing", "critical"), ("b", "missing_contact_information", "warning")]


def merged(base, fallback):
    """A base filled by a fallback, by recursion."""
    if isinstance(base, dict) and isinstance(fallback, dict):
        out = dict(base)
        for k, v in fallback.items():
            out[k] = merged(out[k], v) if k in out and isinstance(out[k], dict) and isinstance(v, dict) else v if k not in out or out[k] in (None, "", [], {}) else out[k]
        return out
    return fallback if base in (None, "", [], {}) and not isinstance(base, (bool, int)) else base


def record(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < .3:
        return rnd.choice(["t", "", None, [], {}, ["x", {"y": 1}], 0, False, 7, "q\"uote"])
    return {k: record(rnd, depth - 1) for k in rnd.sample(["a", "b", "c d", "e.f"], rnd.randint(0, 4))}


@pytest.mark.parametrize("depth", [1, 4])
def test_nested_merge_equals_recursion(spark, depth):
    rnd = random.Random(depth)
    pairs = [(i, record(rnd, depth), record(rnd, depth)) for i in range(80)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "id int, a string, b string").selectExpr("id", "parse_json(a) AS base", "parse_json(b) AS fallback")
    got = {r.id: json.loads(r.j) for r in merge.merge_missing(df).selectExpr("id", "to_json(merged) AS j").collect()}
    for i, a, b in pairs:
        assert got[i] == merged(a, b), (i, a, b)


def test_nested_merge_of_null_records(spark):
    df = spark.createDataFrame([(1, None, '{"a":1}'), (2, '{"a":1}', None), (3, None, None)], "id int, a string, b string").selectExpr("id", "parse_json(a) AS base", "parse_json(b) AS fallback")
    assert {r.id: r.j for r in merge.merge_missing(df).selectExpr("id", "to_json(merged) AS j").collect()} == {1: '{"a":1}', 2: '{"a":1}', 3: "null"}


def test_public_records_from_fields_and_lines(spark):
    entries = [{"type": "Lien", "court": "Kent  County Court AB-1234", "details": ["Court Name: other", "Status | Paid", "status: late", "Amount $5", "paid date", "kept line", "Lien", "Liability:  joint "], "sourcePages": [2, 2, 0]},
               {"lines": ["Reference number 77", "Type: Judgment"], "fileNumber": "not reported"}, "  a plain   text ", "", 7, {"court": "Court 12", "summary": "none"}, {}]
    rows = {r.record_ord: r for r in c.public_records(found(spark, body("equifax_old_v1", {"publicRecords": {"records": entries}}, pageWindows={"publicRecords": [9, 9]}))).collect()}
    assert sorted(rows) == [0, 1, 2, 5, 6]
    a, b, t, d, e = (rows[i] for i in (0, 1, 2, 5, 6))
    assert (a.record_type, a.court, a.reference_number, a.status, a.amount, a.date_paid, a.liability) == ("Lien", "Kent County Court", "AB-1234", "Paid", "$5", None, "joint")
    assert (a.summary, a.details, a.source_pages) == ("kept line", ["kept line"], [2])
    assert (b.record_type, b.reference_number, b.summary, b.details, b.source_pages) == ("Judgment", "77", "Reference number 77", ["Reference number 77"], [9])
    assert (t.summary, t.details, t.record_type) == ("a plain text", ["a plain text"], None)
    assert (d.court, d.reference_number, e.summary, e.details) == ("Court 12", None, "Public record", ["Public record"])
