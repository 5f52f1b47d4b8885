"""Every component of whole extraction payloads, read as variants and conformed from four layouts.

A payload is one JSON text of any depth. It is parsed once into a VARIANT; fields are then paths, lists are
arrays of variants, and the four layouts are columns of path tables, so each component is one projection (and
one explode where it is a list) over the payload rows. Lists are exploded inside their payload, which is a
document, never gathered. flatten() walks what no table names, a level of nesting a round.

Odd inputs: text that is no JSON object, or has neither result nor components, is no payload; an unknown
profile counts as the first layout; a path that is absent or holds another kind of value is null (an empty list
where a list is asked for).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions.text import add, clean_account_number, field_provenance_id, first_meaningful, lit, match_text, month_provenance_id, norm_text, one_of, page_list, rx, unique_ci
from tradeglass.operators.history import cells_from_dated_entries, cells_from_flat, cells_from_year_rows, label_to_series
from tradeglass.session import stored

OLD, EXPERIAN, NEW, TRANSUNION = LAYOUTS = ("equifax_old_v1", "experian_acr_v1", "equifax_new_v1", "transunion_acr_v1")
BUREAUS = ("Equifax", "Experian", "Equifax", "TransUnion")

# --- fixed values: where each layout keeps a report's fields, first that is present wins ----------
REPORT_PATHS = {
    "report_date": (
        ["components.reportConfirmationDetails.reportDate", "components.summary.reportDate", "meta.reportDate"],
        ["components.reportOverview.dateGenerated", "meta.reportDate"],
        ["components.reportConfirmationDetails.reportDate", "components.summary.reportDate", "meta.reportDate"],
        ["components.reportOverview.creditReportDate", "components.reportOverview.dateCreated", "meta.reportDate"]),
    "consumer_name": (
        ["components.reportConfirmationDetails.consumerName"], ["components.reportOverview.consumerName"],
        ["components.reportConfirmationDetails.consumerName"], ["components.reportOverview.consumerName"]),
    "confirmation_number": (
        ["components.reportConfirmationDetails.confirmationNumber"], ["components.reportOverview.reportNumber"],
        ["components.reportConfirmationDetails.confirmationNumber"], ["components.reportOverview.fileNumber"]),
    "credit_file_status": (["components.summary.creditFileStatus"], [], [], []),
    "alert_contacts": (["components.summary.alertContacts"], [], [], []),
    "average_account_age": (["components.summary.averageAccountAge"], [], ["components.summary.averageAccountAge"], []),
    "length_of_credit_history": (["components.summary.lengthOfCreditHistory"], [], ["components.summary.lengthOfCreditHistory"], []),
    "accounts_with_negative_info": (["components.summary.accountsWithNegativeInfo"], [], [], []),
    "oldest_account": (["components.summary.oldestAccount"], [], ["components.summary.oldestAccount"], []),
    "recent_account": (["components.summary.recentAccount"], [], ["components.summary.mostRecentAccount"], []),
    "recent_inquiry": (["components.otherItemsSummary.recentInquiry"], [], [], []),
}
PERSON_PATHS = {
    "name": (
        ["components.personalInformation.name", "components.reportConfirmationDetails.consumerName"],
        ["components.reportOverview.consumerName", "components.personalInformation.names[0]"],
        ["components.personalInformation.name", "components.reportConfirmationDetails.consumerName"],
        ["components.personalInformation.name", "components.reportOverview.consumerName"]),
    "dob": (
        ["components.personalInformation.dateOfBirth"], ["components.personalInformation.yearOfBirth"],
        ["components.personalInformation.dateOfBirth"], ["components.personalInformation.dateOfBirth"]),
}
#: Lists of accounts, in order.
ACCOUNT_LISTS = (["components.accounts.accounts"], ["components.accounts.accounts"], ["components.accounts.accounts"],
                 ["components.adverseAccounts.accounts", "components.satisfactoryAccounts.accounts"])
#: Lists of inquiries with their kind; null where an entry names its own.
INQUIRY_LISTS = ([("components.inquiries.hardInquiries", "hard"), ("components.inquiries.softInquiries", "soft")],
                 [("components.hardInquiries.inquiries", "hard"), ("components.softInquiries.inquiries", "soft")],
                 [("components.inquiries.inquiries", None)],
                 [("components.inquiries.inquiries", "hard"), ("components.accountReviewInquiries.inquiries", "soft")])
#: Stated number of inquiries of each list.
INQUIRY_COUNTS = (["components.inquiries.hardInquiryCount", "components.inquiries.softInquiryCount"],
                  ["components.hardInquiries.inquiryCount", "components.softInquiries.inquiryCount"],
                  ["components.inquiries.inquiryCount"],
                  ["components.inquiries.inquiryCount", "components.accountReviewInquiries.inquiryCount"])
INQUIRY_FIELDS = {
    "subscriber": (["subscriberName"], ["subscriberName"], ["companyName"], ["subscriberName"]),
    "inquiry_date": (["inquiryDate"], ["inquiredOnDates[0]", "inquiryDate"], ["inquiryDates[0]"], ["requestedOn"]),
    "purpose": (["purpose"], ["description"], [], []),
}
#: Lists and single texts that make an inquiry's contact line.
INQUIRY_CONTACT = (["contact"], ["address", "phoneNumber"], ["addressLines", "phoneNumber"], ["location", "phoneNumber"])
COLLECTION_FIELDS = {
    "agency": ["collectionAgency", "agencyName", "summary"], "number": ["accountNumber"], "creditor": ["originalCreditorName"],
    "amount": ["amount", "balance"], "original_amount": ["originalAmountOwed"], "status": ["status"], "date_reported": ["dateReported"],
    "date_assigned": ["dateAssigned"], "balance_date": ["balanceDate"], "last_payment_date": ["lastPaymentDate"], "status_date": ["statusDate"],
    "date_of_first_delinquency": ["dateOfFirstDelinquency"],
}
INDICATOR_FIELDS = {"code": ["code"], "description": ["description", "summary", "code"], "category": ["category"],
                    "linked_name": ["linkedAccountName"], "linked_number": ["linkedAccountNumber"]}
SUMMARY_FIELDS = {"account_type": "accountType", "total_accounts": "totalAccounts", "open_accounts": "open", "with_balance": "withBalance",
                  "total_balance": "totalBalance", "available": "available", "credit_limit": "creditLimit", "debt_to_credit": "debtToCredit", "payment": "payment"}
#: Objects whose scalars are not grounded, and leaves that are counted elsewhere.
SKIPPED_SUBTREES = ["paymentStatusCodes", "collectionFields"]
SKIPPED_LEAVES = ["totalAccounts", "openAccounts", "closedAccounts", "hardInquiryCount", "softInquiryCount", "collectionCount", "inquiryCount",
                  "publicRecordCount", "statementCount", "personalInfoItemCount", "inquiries", "publicRecords"]
UNGROUNDED_TEXTS = ["", "-", "not reported", "not available", "none", "null"]


# --- reading ---------------------------------------------------------------------------------------


def text_at(path: str, v: str = "body") -> str:
    """The text of a scalar (or the JSON of anything else) at a path; null where absent or JSON null."""
    return f"try_variant_get({v}, '$.{path}', 'string')"


def _list(path: str, v: str = "body") -> str:
    return f"coalesce(try_variant_get({v}, '$.{path}', 'array<variant>'), cast(array() AS array<variant>))"


def _size(path: str, v: str = "body") -> str:
    return f"coalesce(size(try_variant_get({v}, '$.{path}', 'array<variant>')), 0)"


def _is_list(path: str, v: str = "body") -> str:
    return f"(try_variant_get({v}, '$.{path}', 'array<variant>') IS NOT NULL)"


def _whole(path: str, v: str = "body") -> str:
    return f"try_variant_get({v}, '$.{path}', 'bigint')"


def texts_at(path: str, v: str = "body") -> str:
    """Texts of a list, or the pieces of a single text cut at line ends, semicolons and bars."""
    pieces = f"filter(transform(split({text_at(path, v)}, {rx('[\\n;|]')}), x -> trim(x)), x -> x <> '')"
    return (f"coalesce(transform(try_variant_get({v}, '$.{path}', 'array<variant>'), x -> coalesce(try_variant_get(x, '$', 'string'), '')), "
            f"if(try_variant_get({v}, '$.{path}', 'map<string,variant>') IS NULL, {pieces}, NULL), cast(array() AS array<string>))")


def unique_texts(*lists: str) -> str:
    """Trimmed texts of several lists without empty ones, the first of each spelling."""
    return unique_ci(f"filter(transform(concat({', '.join(lists)}), x -> trim(x)), x -> x <> '')")


def _present(paths: list[str], v: str = "body") -> str:
    return f"coalesce({', '.join(text_at(p, v) for p in paths)})" if paths else "cast(NULL AS string)"


def _meaningful(paths: list[str], v: str) -> str:
    return first_meaningful(*(text_at(p, v) for p in paths))


def _by_layout(options) -> str:
    cases = " ".join(f"WHEN {lit(name)} THEN {sql}" for name, sql in zip(LAYOUTS[1:], options[1:], strict=True))
    return f"CASE profile_id {cases} ELSE {options[0]} END"


def _pages(path: str, v: str = "body") -> str:
    return page_list(f"transform({_list(path, v)}, x -> try_variant_get(x, '$', 'int'))")


def section_pages(name: str) -> str:
    """Pages that a payload states for a component, in either of two objects and either of two forms."""
    def stated(owner: str) -> str:
        path = f"meta.{owner}.{name}"
        return f"coalesce(try_variant_get(body, '$.{path}', 'array<variant>'), {_list(path + '.pages')})"

    known = "try_variant_get(body, '$.meta.componentSources', 'map<string,variant>') IS NOT NULL"
    return page_list(f"transform(if({known}, {stated('componentSources')}, {stated('pageWindows')}), x -> try_variant_get(x, '$', 'int'))")


def payloads(lines: DataFrame) -> DataFrame:
    """report_id, profile_id, file_name, version and body (the result) of JSON payloads in column value."""
    v = lines.selectExpr("try_parse_json(value) AS v")
    found = v.selectExpr("v", "try_variant_get(v, '$.result', 'variant') AS inner", "try_variant_get(v, '$.result', 'map<string,variant>') IS NOT NULL AS wrapped")
    body = found.selectExpr("v", "if(wrapped, inner, v) AS body", "wrapped").where("wrapped OR try_variant_get(v, '$.components', 'map<string,variant>') IS NOT NULL")
    return body.selectExpr(
        f"coalesce({text_at('meta.sessionId')}, {text_at('reportId')}, {text_at('sessionId', 'v')}) AS report_id",
        f"coalesce({text_at('meta.profileId')}, {text_at('profile')}, {lit(OLD)}) AS profile_id",
        f"{text_at('fileName', 'v')} AS file_name", "try_variant_get(v, '$.version', 'timestamp') AS version", "body")


# --- components ------------------------------------------------------------------------------------


def reports(found: DataFrame) -> DataFrame:
    """One row per payload: names, dates, stated counts and the states of its components."""
    fields = {name: _by_layout([_present(p) for p in paths]) for name, paths in REPORT_PATHS.items()}
    given = [" + ".join(f"coalesce({_whole(c)}, {_size(path)})" for c, (path, _) in zip(counts, lists, strict=True))
             for counts, lists in zip(INQUIRY_COUNTS, INQUIRY_LISTS, strict=True)]
    stated = " + ".join(f"coalesce({_whole(c)}, 0)" for c in INQUIRY_COUNTS[0])
    given[0] = f"coalesce({_whole('components.otherItemsSummary.inquiryCount')}, {stated})"
    records = f"coalesce({_whole('components.publicRecords.publicRecordCount')}, {{}}{_size('components.publicRecords.records')})"
    other = f"{_whole('components.otherItemsSummary.publicRecordCount')}, "
    collections = [f"coalesce({_whole('components.collections.collectionCount')}, {_whole('components.otherItemsSummary.collectionCount')}, 0)", "cast(NULL AS bigint)",
                   f"coalesce({_whole('components.collections.collectionCount')}, {_size('components.collections.collections')})", "cast(NULL AS bigint)"]
    fields |= {"bureau": _by_layout([lit(b) for b in BUREAUS]), "inquiry_count": f"cast({_by_layout(given)} AS bigint)",
               "public_record_count": f"cast({_by_layout([records.format(other), *[records.format('')] * 3])} AS bigint)",
               "collection_count": f"cast({_by_layout(collections)} AS bigint)",
               "component_status": "transform_values(coalesce(try_variant_get(body, '$.componentStatus', 'map<string,variant>'), cast(map() AS map<string,variant>)), "
                                   "(k, s) -> coalesce(try_variant_get(s, '$.status', 'string'), try_variant_get(s, '$', 'string')))",
               "ready": "coalesce(try_variant_get(body, '$.readyForAttorney', 'boolean'), false)"}
    return found.selectExpr("report_id", "profile_id", "file_name", *(f"{sql} AS {name}" for name, sql in fields.items()))


def people(found: DataFrame) -> DataFrame:
    """Name, birth, address lists, identity numbers and employers of each payload's consumer."""
    info = "components.personalInformation"
    current = f"if({text_at(info + '.currentAddress')} <> '', array({text_at(info + '.currentAddress')}), cast(array() AS array<string>))"
    many = texts_at(info + ".socialSecurityNumbers")
    both = unique_texts(many, f"array(coalesce({text_at(info + '.socialSecurityNumber')}, ''))")
    none = "cast(array() AS array<string>)"
    fields = {
        **{name: _by_layout([_present(p) for p in paths]) for name, paths in PERSON_PATHS.items()},
        "addresses": _by_layout([texts_at(info + ".addresses"), texts_at(info + ".addresses"),
                                 f"filter(concat(coalesce({current}, {none}), {texts_at(info + '.formerAddresses')}), x -> x <> '')", texts_at(info + ".addresses")]),
        "current_addresses": _by_layout([texts_at(info + ".currentAddresses"), none, f"coalesce({current}, {none})", texts_at(info + ".currentAddresses")]),
        "previous_addresses": _by_layout([texts_at(info + ".previousAddresses"), none, texts_at(info + ".formerAddresses"), texts_at(info + ".previousAddresses")]),
        "ssns": _by_layout([both, unique_texts(many), both, both]),
        "employment": _by_layout([text_at(info + ".employmentHistory"), *(f"nullif(array_join({texts_at(info + '.' + p)}, '; '), '')" for p in ("employers", "employmentInformation", "employers"))]),
    }
    return add(found.select("report_id", "profile_id", "body"), fields).selectExpr("report_id", *(f"coalesce(name, 'Not reported') AS name" if n == "name" else n for n in fields))


def _accounts(found: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """One row per account: its place, variant, printed name and number."""
    lists = _by_layout([f"concat({', '.join(map(_list, paths))})" if len(paths) > 1 else _list(paths[0]) for paths in ACCOUNT_LISTS])
    rows = found.selectExpr("report_id", "profile_id", *(carried or []), f"posexplode({lists}) AS (account_ord, a)")
    name = [_present(["accountName"], "a"), _meaningful(["accountInfo.accountName", "header.accountName", "accountName"], "a"),
            _present(["accountName"], "a"), _present(["accountName", "accountInfo.accountName"], "a")]
    number = [_present(["accountNumber"], "a"), _meaningful(["accountInfo.accountNumber", "header.accountNumber", "accountNumber"], "a"),
              _present(["accountNumber"], "a"), _present(["accountNumber", "accountInfo.accountNumber"], "a")]
    named = add(rows, {"account_name": f"coalesce({_by_layout(name)}, 'Not reported')", "account_number": f"coalesce({_by_layout(number)}, 'Not reported')"})
    return add(named, {"entity_key": f"concat({match_text('account_name')}, '::', {norm_text('account_number')})"})


def tradelines(found: DataFrame) -> DataFrame:
    """Account rows in the schema the rules read: raw holds every scalar of the account and of its inner objects, dotted.

    An absent field has no entry, a JSON null an entry without value. Pages are the account's own, else those that the
    source list gives its name and number, else those of the accounts section.
    """
    a = _accounts(found, ["body"])
    fields = "coalesce(try_variant_get(a, '$', 'map<string,variant>'), cast(map() AS map<string,variant>))"
    inner = "try_variant_get(e.value, '$', 'map<string,variant>')"
    flat = (f"flatten(transform(map_entries({fields}), e -> if({inner} IS NULL, array(struct(e.key AS key, e.value AS value)), "
            f"transform(map_entries({inner}), f -> struct(concat(e.key, '.', f.key) AS key, f.value AS value)))))")
    scalar = "try_variant_get(e.value, '$', 'map<string,variant>') IS NULL AND try_variant_get(e.value, '$', 'array<variant>') IS NULL"
    raw = f"map_from_entries(transform(filter({flat}, e -> {scalar}), e -> struct(e.key, try_variant_get(e.value, '$', 'string') AS value)))"
    said = "filter(transform({0}, x -> try_variant_get(x, '$.description', 'string')), x -> x <> '')".format(_list("narrativeCodes", "a"))
    remark = f"if({text_at('accountInfo.remarks', 'a')} NOT IN ('', 'Not reported'), array({text_at('accountInfo.remarks', 'a')}), cast(array() AS array<string>))"
    comments = [texts_at("comments", "a"), unique_texts(*(texts_at(p, "a") for p in ("accountInfo.comments", "comments", "contactInfo.comments"))),
                said, f"coalesce({remark}, cast(array() AS array<string>))"]
    one = "array_compact(array(nullif({0}, '')))"
    contact = [texts_at("contact", "a"), unique_texts(*(texts_at(p, "a") for p in ("contactInfo.addressLines", "contactInfo.phoneNumbers", "contact"))),
               f"array_compact(array(nullif({text_at('address', 'a')}, ''), nullif({text_at('phoneNumber', 'a')}, '')))",
               f"concat({texts_at('contactInfo.address', 'a')}, {one.format(text_at('contactInfo.phoneNumber', 'a'))})"]
    listed = (f"transform(filter({_list('meta.accountSources')}, s -> concat({match_text("try_variant_get(s, '$.accountName', 'string')")}, '::', "
              f"{norm_text("try_variant_get(s, '$.accountNumber', 'string')")}) = entity_key), s -> {_pages('pages', 's')})")
    given = f"try_element_at(filter({listed}, p -> size(p) > 0), -1)"
    section = section_pages("accounts")
    own = _pages("sourcePages", "a")
    closed = [_present(["isClosed"], "a"), _present(["header.isClosed", "isClosed"], "a"), _present(["isClosed"], "a"), _present(["isClosed"], "a")]
    rows = add(a, {"given_pages": f"if(size(coalesce({listed}, array())) > 0, {given}, NULL)"})
    return rows.selectExpr(
        "report_id", "profile_id", f"{_by_layout([_present(p) for p in REPORT_PATHS['report_date']])} AS report_date", "account_ord", "account_name",
        "account_number", "entity_key", f"{raw} AS raw", f"{_by_layout(comments)} AS comments", f"{_by_layout(contact)} AS contact",
        f"{_by_layout([f'coalesce(given_pages, {section})', own, own, own])} AS source_pages", f"coalesce({_by_layout(closed)}, 'false') = 'true' AS closed_flag")


YEAR_ROW = "struct<year:string," + ",".join(f"{m.lower()}:string" for m in vocab.MONTHS) + ">"


def _year_rows(path: str, v: str) -> str:
    return f"coalesce(try_variant_get({v}, '$.{path}', 'array<{YEAR_ROW}>'), cast(array() AS array<{YEAR_ROW}>))"


def history_cells(found: DataFrame) -> DataFrame:
    """report_id, entity_key, series, m, value_text of every printed month of every layout.

    Flat values with their years, year rows, dated entries, and labelled or keyed sections of year rows.
    """
    a = _accounts(found, ["body"])
    keep = ["report_id", "entity_key"]
    evidence = (f"try_element_at(filter({_list('meta.accountHistoryEvidence')}, s -> concat({match_text("try_variant_get(s, '$.accountName', 'string')")}, '::', "
                f"{norm_text("try_variant_get(s, '$.accountNumber', 'string')")}) = entity_key), -1)")
    years = f"filter(transform({_list('fields.paymentHistory', 'e')}, r -> trim(coalesce(try_variant_get(r, '$.year', 'string'), ''))), y -> y RLIKE {rx(r'^\d{4}$')})"
    flat = a.where(_in(OLD)).selectExpr(*keep, f"{texts_at('paymentHistory', 'a')} AS values", f"if(size({_list('meta.accountHistoryEvidence')}) > 0, {evidence}, NULL) AS e")
    flat = cells_from_flat(flat.selectExpr(*keep, "'status' AS series", f"{years} AS years", "values"))

    def printed(rows: DataFrame, lists: str) -> DataFrame:
        """Year rows of (series, rows) structs."""
        return cells_from_year_rows(rows.selectExpr(*keep, f"inline({lists})").selectExpr(*keep, "series", "inline(rows)"))

    status = f"if(size({_year_rows('paymentHistory', 'a')}) > 0, {_year_rows('paymentHistory', 'a')}, {_year_rows('paymentHistory.rows', 'a')})"
    sections = f"transform({_list('month24History.sections', 'a')}, s -> struct({label_to_series("try_variant_get(s, '$.key', 'string')")} AS series, {_year_rows('rows', 's')} AS rows))"
    labelled = f"transform({_list('balanceHistories', 'a')}, s -> struct({label_to_series("try_variant_get(s, '$.label', 'string')")} AS series, {_year_rows('rows', 's')} AS rows))"
    plain = printed(a.where(f"NOT {_in(OLD)}"), f"array(struct('status' AS series, {status} AS rows))")
    new, union = printed(a.where(_in(NEW)), sections), printed(a.where(_in(TRANSUNION)), labelled)
    entry = "struct<date:string,balance:string,scheduledPayment:string,paid:string>"
    dated = a.where(_in(EXPERIAN)).selectExpr(*keep, f"inline(try_variant_get(a, '$.balanceHistories', 'array<{entry}>'))")
    dated = cells_from_dated_entries(dated.selectExpr(*keep, "date", "balance", "scheduledPayment AS scheduled", "paid"), {"balance": "balance", "scheduled": "scheduled", "paid": "paid"})
    out = flat
    for more in (plain, new, union, dated):
        out = out.unionByName(more)
    return out.select(*keep, "series", "m", "value_text")


def _in(*layouts: str) -> str:
    """Rows of these layouts; unknown profiles count as the first."""
    others = [x for x in LAYOUTS if x != OLD]
    return f"(profile_id IN ({', '.join(map(lit, layouts))}){f' OR profile_id NOT IN ({", ".join(map(lit, others))})' if OLD in layouts else ''})"


def collections(found: DataFrame) -> DataFrame:
    """Rows of the collections section; one layout prints them among its accounts and has none here."""
    rows = found.where(f"NOT {_in(EXPERIAN)}").selectExpr("report_id", "profile_id", "body", f"posexplode({_list('components.collections.collections')}) AS (ord, c)")
    section = section_pages("collections")
    said = unique_texts(f"if(size({texts_at('comments', 'c')}) > 0, {texts_at('comments', 'c')}, if(size({texts_at('details', 'c')}) > 0, {texts_at('details', 'c')}, {texts_at('lines', 'c')}))")
    return rows.selectExpr("report_id", "ord", *(f"{_meaningful(paths, 'c')} AS {name}" for name, paths in COLLECTION_FIELDS.items()), f"{said} AS comments",
                           f"if(size({_pages('sourcePages', 'c')}) > 0, {_pages('sourcePages', 'c')}, {section}) AS source_pages")


def inquiries(found: DataFrame) -> DataFrame:
    """Inquiries of all lists with kind, subscriber, date, purpose, contact line and place in their list."""
    def listed(lists: list[tuple[str, str | None]]) -> str:
        kind = "if(lower(trim(try_variant_get(x, '$.inquiryType', 'string'))) = 'hard', 'hard', 'soft')"
        parts = [f"transform({_list(path)}, (x, i) -> struct({lit(k) if k else kind} AS kind, i AS ord, x AS q))" for path, k in lists]
        return f"concat({', '.join(parts)})"

    rows = found.selectExpr("report_id", "profile_id", f"inline({_by_layout([listed(x) for x in INQUIRY_LISTS])})")
    fields = {name: _by_layout([_present(p, "q") for p in paths]) for name, paths in INQUIRY_FIELDS.items()}
    lines = [f"nullif(array_join(filter(concat({', '.join(texts_at(p, 'q') if p != 'phoneNumber' else f'array(coalesce({text_at(p, "q")}, {lit("")}))' for p in paths)}), x -> x <> ''), ' | '), '')"
             for paths in INQUIRY_CONTACT]
    return rows.selectExpr("report_id", "kind", "ord", *(f"{sql} AS {name}" for name, sql in fields.items()), f"{_by_layout(lines)} AS contact")


#: Keys of an entry that say a field outright, before its printed lines do.
RECORD_KEYS = {
    "record_type": ["recordType", "type"], "court": ["court"], "reference_number": ["referenceNumber", "fileNumber"], "status": ["status"], "amount": ["amount"],
    "date_filed": ["dateFiled", "filedDate"], "date_resolved": ["dateResolved", "resolvedDate"], "date_paid": ["datePaid"], "address": ["address"], "phone": ["phoneNumber"],
    "court_type": ["courtType"], "date_updated": ["dateUpdated"], "estimated_removal": ["estimatedRemoval"], "plaintiff_attorney": ["plaintiffAttorney"],
    "responsibility": ["responsibility"], "liability": ["liability"],
}
#: A court's name with the identifier that trails it.
COURT_AND_NUMBER = r"(?i)^(.*?\bcourt\b.*?)\s+([A-Z0-9-]*\d[A-Z0-9-]{3,})$"


def public_records(found: DataFrame) -> DataFrame:
    """One row per public record: its fields, summary, the printed lines that say none of them, and pages.

    A field is what the entry says, else what its first line with a label of the field says; the label ends at a colon
    or bar, or at a space. The number that trails a court's name is the reference where there is none. An
    entry may be a text, which is its own summary; entries that are neither text nor object are left out.
    """
    rows = found.selectExpr("report_id", "profile_id", "body", f"posexplode({_list('components.publicRecords.records')}) AS (record_ord, r)")
    rows = add(rows, {"is_text": "schema_of_variant(r) = 'STRING'", "whole": norm_text("try_variant_get(r, '$', 'string')")})
    rows = rows.where("(is_text AND whole <> '') OR try_variant_get(r, '$', 'map<string,variant>') IS NOT NULL")
    known = f"{text_at('details', 'r')} IS NOT NULL"
    lines = unique_texts(f"if({known}, {texts_at('details', 'r')}, {texts_at('lines', 'r')})")
    rows = add(rows, {"details": f"transform(if(is_text, array(whole), {lines}), d -> {norm_text('d')})"})
    labels = ", ".join(f"struct({lit(label)} AS label, {lit(field)} AS field)" for label, field in vocab.PUBLIC_RECORD_LABELS)
    rest = "substring(d, length(l.label) + 1)"
    marked = rx(r"^\s*[|:]\s*\S")
    value = (f"CASE WHEN NOT startswith(lower(d), l.label) THEN NULL WHEN {rest} RLIKE {marked} THEN trim(regexp_replace({rest}, {rx(r'^\s*[|:]\s*')}, '')) "
             f"WHEN {rest} RLIKE {rx(r'^ [^|: ]')} THEN trim({rest}) END")
    said = f"transform(details, d -> get(filter(transform(array({labels}), l -> struct(l.field AS field, {value} AS value)), x -> x.value IS NOT NULL), 0))"
    rows = add(rows, {"said": f"if(is_text, NULL, filter({said}, x -> x IS NOT NULL))"})
    fields = {f: first_meaningful(*(text_at(p, "r") for p in keys), f"get(filter(said, x -> x.field = '{f}'), 0).value") for f, keys in RECORD_KEYS.items()}
    rows = add(rows, {f: f"if(is_text, NULL, {sql})" for f, sql in fields.items()})
    split = f"reference_number IS NULL AND court RLIKE {rx(COURT_AND_NUMBER)}"
    rows = rows.withColumns({"reference_number": F.expr(f"if({split}, regexp_extract(court, {rx(COURT_AND_NUMBER)}, 2), reference_number)"),
                             "court": F.expr(f"if({split}, trim(regexp_extract(court, {rx(COURT_AND_NUMBER)}, 1)), court)")})
    structured = f"array_compact(array({', '.join(f'lower({f})' for f in RECORD_KEYS)}))"
    names = ", ".join(lit(label) for label, _ in vocab.PUBLIC_RECORD_LABELS)
    labelled = f"exists(array({names}), l -> lower(d) = l OR startswith(lower(d), concat(l, ' ')) OR startswith(lower(d), concat(l, ':')))"
    rows = add(rows, {"left_over": f"if(is_text, details, filter(details, d -> NOT array_contains({structured}, lower(d)) AND NOT {labelled}))"})
    rows = add(rows, {"summary": f"coalesce(if(is_text, whole, {first_meaningful(text_at('summary', 'r'), text_at('recordType', 'r'), 'get(left_over, 0)', 'get(details, 0)')}), 'Public record')"})
    pages = f"if(is_text OR NOT {_is_list('sourcePages', 'r')}, {section_pages('publicRecords')}, {_pages('sourcePages', 'r')})"
    return rows.selectExpr("report_id", "record_ord", *RECORD_KEYS, "summary", "if(size(left_over) > 0, left_over, array(summary)) AS details", f"{pages} AS source_pages")


def indicators(found: DataFrame) -> DataFrame:
    """Raw consumer information indicators of each payload."""
    rows = found.selectExpr("report_id", "body", f"posexplode({_list('components.consumerInformationIndicators.indicators')}) AS (ind_ord, i)").where(
        "try_variant_get(i, '$', 'map<string,variant>') IS NOT NULL")
    return rows.selectExpr("report_id", "ind_ord", *(f"{_meaningful(paths, 'i')} AS {name}" for name, paths in INDICATOR_FIELDS.items()),
                           f"if(size({_pages('sourcePages', 'i')}) > 0, {_pages('sourcePages', 'i')}, {section_pages('consumerInformationIndicators')}) AS source_pages")


def summary_rows(found: DataFrame) -> DataFrame:
    """Account summary rows as printed; one layout prints them."""
    rows = found.where(_in(OLD)).selectExpr("report_id", f"posexplode({_list('components.creditAccountsSummary')}) AS (ord, s)")
    return rows.selectExpr("report_id", "ord", *(f"{text_at(path, 's')} AS {name}" for name, path in SUMMARY_FIELDS.items()))


def component_windows(found: DataFrame) -> DataFrame:
    """report_id, component, pages as the payload states them, in either of two forms; a layout that prints accounts in two sections has both."""
    body = "coalesce(try_variant_get(body, '$.meta.componentSources', 'map<string,variant>'), try_variant_get(body, '$.meta.pageWindows', 'map<string,variant>'))"
    rows = found.selectExpr("report_id", "profile_id", f"explode({body}) AS (component, w)")
    plain = "try_variant_get(w, '$', 'array<variant>')"
    pages = f"transform(coalesce({plain}, try_variant_get(w, '$.pages', 'array<variant>'), cast(array() AS array<variant>)), x -> try_variant_get(x, '$', 'int'))"
    rows = rows.selectExpr("report_id", "profile_id", "component", f"{page_list(pages)} AS pages")
    halves = rows.where(f"profile_id = {lit(TRANSUNION)}").groupBy("report_id")
    both = halves.agg(*_both()).where("NOT given").selectExpr("report_id", f"{lit(TRANSUNION)} AS profile_id", "'accounts' AS component", "pages")
    return rows.unionByName(both).select("report_id", "component", "pages")


def _both() -> list:
    part = "coalesce(max(if(component = '{0}', pages, NULL)), cast(array() AS array<int>))"
    return [F.expr("bool_or(component = 'accounts' AND size(pages) > 0) AS given"),
            F.expr(f"array_distinct(concat({part.format('adverseAccounts')}, {part.format('satisfactoryAccounts')})) AS pages")]


# --- recorded evidence -----------------------------------------------------------------------------


def history_evidence(found: DataFrame) -> DataFrame:
    """report_id, path, value, page of every month cell whose page the extraction recorded.

    Paths are those of the components: flat or row-wise payment history, row-wise money histories, and the
    sections of a 24-month history, which are named by key in the evidence and by place in the path.
    """
    accounts = _list("components.accounts.accounts")
    entries = found.selectExpr("report_id", f"posexplode(transform({_list('meta.accountHistoryEvidence')}, (e, i) -> struct(e, get({accounts}, i) AS a))) AS (i, x)")
    fields = entries.selectExpr("report_id", "i", "x.a AS a", "explode(try_variant_get(x.e, '$.fields', 'map<string,variant>')) AS (field, rows)")
    rows = fields.selectExpr("report_id", "i", "a", "field", f"posexplode({_list('', 'rows').replace('$.', '$')}) AS (row, r)")
    cells = rows.selectExpr("report_id", "i", "a", "field", "row", "explode(try_variant_get(r, '$.months', 'map<string,variant>')) AS (month, cell)")
    months = ", ".join(lit(m.lower()) for m in vocab.MONTHS)
    place = f"array_position(transform({_list('month24History.sections', 'a')}, s -> {norm_text("try_variant_get(s, '$.key', 'string')")}), substring(field, 9)) - 1"
    paths = ("CASE WHEN field = 'paymentHistory' THEN array(concat(base, '.paymentHistory[', row * 12 + at, ']'), concat(base, '.paymentHistory[', row, '].', month)) "
             f"WHEN field LIKE 'month24:%' THEN array(concat(base, '.month24History.sections[', {place}, '].rows[', row, '].', month)) "
             "ELSE array(concat(base, '.', field, '[', row, '].', month)) END")
    placed = add(cells, {"base": "concat('components.accounts.accounts[', i, ']')", "at": f"array_position(array({months}), month) - 1"}).where("at >= 0")
    return placed.selectExpr("report_id", f"explode({paths}) AS path", f"{text_at('value', 'cell')} AS value", "try_variant_get(cell, '$.pageNumber', 'int') AS page").where("page > 0")


def inquiry_evidence(found: DataFrame) -> DataFrame:
    """report_id, path, value, page of inquiry fields whose pages the extraction recorded; a purpose is proven by its entry alone."""
    lists = [("hardInquiries", "hard"), ("softInquiries", "soft")]
    sources = ", ".join(f"struct({lit(name)} AS list, {_list('meta.inquiryEvidence.' + name)} AS entries, {_list('components.inquiries.' + name)} AS own)" for name, _ in lists)
    entries = found.selectExpr("report_id", f"inline(array({sources}))").selectExpr("report_id", "list", "posexplode(transform(entries, (e, i) -> struct(e, get(own, i) AS own))) AS (i, x)")
    names = [("contact", "x.e"), ("subscriberName", "x.e"), ("inquiryDate", "x.e"), ("purpose", "x.own")]
    fields = ", ".join(f"struct({lit(n)} AS field, {text_at(n, v)} AS value)" for n, v in names)
    rows = entries.selectExpr("report_id", "list", "i", f"{_pages('pages', 'x.e')} AS pages", f"inline(array({fields}))").where("value IS NOT NULL")
    return rows.selectExpr("report_id", "concat('components.inquiries.', list, '[', i, '].', field) AS path", "value", "explode(pages) AS page")


PROVENANCE = ["report_id", "component", "name", "number", "field", "year", "month", "page", "box", "provenance_id"]


def provenance(found: DataFrame) -> DataFrame:
    """PROVENANCE rows: where each account field, month cell, collection and inquiry is printed.

    A field or month has the box of its value and the id the extraction gave it, else one made of name, number and place; a
    field without box or page is left out, a month without box too. Collections and inquiries have a row a page.
    """
    box = "try_variant_get({0}, '$.bbox', 'array<double>')"
    name, number = "coalesce(trim(try_variant_get(e, '$.accountName', 'string')), '')", "coalesce(trim(try_variant_get(e, '$.accountNumber', 'string')), '')"
    none, text = "cast(NULL AS array<double>)", "cast(NULL AS string)"
    fields = found.selectExpr("report_id", f"explode({_list('meta.accountFieldEvidence')}) AS e").selectExpr("report_id", f"{name} AS name", f"{number} AS number", "explode(try_variant_get(e, '$.fields', 'map<string,variant>')) AS (field, d)")
    fields = add(fields, {"page": "try_variant_get(d, '$.pageNumber', 'int')", "box": box.format("d")}).where("page > 0 AND size(box) > 0")
    a = fields.selectExpr("report_id", "'accounts' AS component", "name", "number", "field", f"{text} AS year", f"{text} AS month", "page", "box",
                          f"coalesce({text_at('id', 'd')}, {field_provenance_id('name', 'number', 'field')}) AS provenance_id")
    rows = found.selectExpr("report_id", f"explode({_list('meta.accountHistoryEvidence')}) AS e").selectExpr("report_id", f"{name} AS name", f"{number} AS number", "explode(try_variant_get(e, '$.fields', 'map<string,variant>')) AS (field, rows)")
    rows = rows.selectExpr("report_id", "name", "number", "field", f"explode({_list('', 'rows').replace('$.', '$')}) AS r").selectExpr(
        "report_id", "name", "number", "field", f"{text_at('year', 'r')} AS row_year", "explode(try_variant_get(r, '$.months', 'map<string,variant>')) AS (month, d)")
    rows = add(rows, {"year": f"coalesce(nullif({text_at('year', 'd')}, ''), row_year, '')", "box": box.format("d")}).where("size(box) > 0")
    b = rows.selectExpr("report_id", "'accounts' AS component", "name", "number", "field", "year", "month", "try_variant_get(d, '$.pageNumber', 'int') AS page", "box",
                        f"coalesce({text_at('id', 'd')}, {month_provenance_id('name', 'number', 'field', 'year', 'month')}) AS provenance_id")
    gathered = found.selectExpr("report_id", f"explode({_list('meta.collectionSources')}) AS e")
    c = gathered.selectExpr("report_id", "'collections' AS component", f"{norm_text(text_at('collectionAgency', 'e'))} AS name", f"{clean_account_number(text_at('accountNumber', 'e'))} AS number",
                            f"{norm_text(text_at('originalCreditorName', 'e'))} AS field", f"{text} AS year", f"{text} AS month", f"explode({_pages('pages', 'e')}) AS page", f"{none} AS box", f"{text} AS provenance_id")
    asked = found.selectExpr("report_id", f"inline(concat(transform({_list('meta.inquiryEvidence.hardInquiries')}, x -> struct('hardInquiries' AS list, x AS e)), "
                                          f"transform({_list('meta.inquiryEvidence.softInquiries')}, x -> struct('softInquiries' AS list, x AS e))))")
    d = asked.selectExpr("report_id", "'inquiries' AS component", f"{norm_text(text_at('subscriberName', 'e'))} AS name", f"{norm_text(text_at('inquiryDate', 'e'))} AS number", "list AS field",
                         f"{text} AS year", f"{text} AS month", f"explode({_pages('pages', 'e')}) AS page", f"{none} AS box", f"{text} AS provenance_id")
    return a.unionByName(b).unionByName(c).unionByName(d).select(*PROVENANCE)


# --- everything else -------------------------------------------------------------------------------


def flatten(found: DataFrame) -> DataFrame:
    """(report_id, path, component, value) of every text worth grounding on a page, at any depth.

    A level of nesting is a round: what a node holds is written, and its objects and lists are the next
    round's nodes, until there are none. Objects under a skipped name, numbers, flags, placeholders, counters and
    numbers of at most three digits are left out; those are checked by counts.
    """
    nodes = found.selectExpr("report_id", "'components' AS path", "'components' AS name", "try_variant_get(body, '$.components', 'variant') AS v")
    entries = f"if({one_of('name', SKIPPED_SUBTREES)}, NULL, try_variant_get(v, '$', 'map<string,variant>'))"
    items = "try_variant_get(v, '$', 'array<variant>')"
    child = (f"inline(coalesce(transform(map_entries({entries}), e -> struct(concat(path, '.', e.key) AS path, e.key AS name, e.value AS v)), "
             f"transform({items}, (x, i) -> struct(concat(path, '[', i, ']') AS path, concat(name, '[', i, ']') AS name, x AS v))))")
    is_node = "try_variant_get(v, '$', 'map<string,variant>') IS NOT NULL OR try_variant_get(v, '$', 'array<variant>') IS NOT NULL"
    levels = []
    while True:
        below = stored(nodes.selectExpr("report_id", child), "payload-level")
        levels.append(below)
        nodes = below.where(is_node)
        if nodes.isEmpty():
            break
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    kind = "schema_of_variant(v) = 'STRING'"
    value = "try_variant_get(v, '$', 'string')"
    low = match_text("value")
    short = f"({low} RLIKE {rx(r'^[\d,\.%$]+$')} AND length(regexp_replace({low}, '[^0-9]', '')) <= 3)"
    leaf = f"regexp_replace(name, {rx(r'\[.*$')}, '')"
    texts = rows.where(f"NOT ({is_node}) AND {kind} AND NOT {one_of(leaf, SKIPPED_LEAVES)}").selectExpr("report_id", "path", f"{value} AS value")
    return texts.where(f"NOT {one_of(low, UNGROUNDED_TEXTS)} AND NOT {short}").selectExpr(
        "report_id", "path", f"regexp_extract(path, {rx(r'^components\.([a-zA-Z_]+)')}, 1) AS component", "value")
