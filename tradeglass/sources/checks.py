"""Checks of whole payloads: required fields, shapes, counts against each other, row order, repeats, foreign text.

Each check is a predicate over the payload's variant with the component, code, severity and path of its issue, so
all checks of a payload are one projection and a payload without issues gives no row. Checks of accounts and
collections run over the lists inside the payload; nothing is joined or gathered across payloads.

Odd inputs: a component that is absent, or not of the kind asked for, fails the checks of its shape and passes those of
its parts; entries that are no objects are named by invalid_account_entry alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradeglass import vocab
from tradeglass.functions.text import lit, match_text, norm_text, one_of, rx
from tradeglass.sources.components import NEW, text_at

# --- fixed values ---------------------------------------------------------------------------------
HISTORIES = ["balanceHistory", "scheduledPaymentHistory", "actualPaymentHistory", "creditLimitHistory", "amountPastDueHistory", "activityDesignatorHistory"]
#: Texts of other parts of a report that a reader can take for a name.
FOREIGN_PHRASES = ["or lender if you have any questions", "view detailed information", "the tables below show", "credit accounts", "other items",
                   "collections stay on your", "page "]
SECTION_HEADERS = ["comments", "contact", "comments contact", "comments | contact"]
PLACEHOLDERS = ["", "-", "not reported", "not available", "none", "null"]
SUMMARY_COLUMNS = ["totalAccounts", "open", "withBalance", "totalBalance", "available", "creditLimit", "debtToCredit", "payment"]
DAY = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b[a-z]{3,9}\s+\d{1,2},\s+\d{4}\b"


def _get(path: str, kind: str, v: str = "body") -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def _is_list(path: str, v: str = "body") -> str:
    return f"({_get(path, 'array<variant>', v)} IS NOT NULL)"


def _items(path: str, v: str = "body") -> str:
    return f"coalesce({_get(path, 'array<variant>', v)}, cast(array() AS array<variant>))"


def _empty(path: str, v: str = "body") -> str:
    return f"({norm_text(text_at(path, v))} = '')"


def _int(path: str, v: str = "body") -> str:
    """A JSON integer; null for any other kind."""
    return f"if(schema_of_variant({_get(path, 'variant', v)}) = 'BIGINT', {_get(path, 'bigint', v)}, NULL)"


def _digits(path: str, v: str) -> str:
    """The whole number that a printed count holds; null without a digit."""
    return f"try_cast(nullif(regexp_replace(coalesce({text_at(path, v)}, ''), '[^0-9]', ''), '') AS bigint)"


def _has_phrase(path: str, phrases: list[str], v: str) -> str:
    text = match_text(text_at(path, v))
    return "(" + " OR ".join(f"contains({text}, {lit(p)})" for p in phrases) + ")"


def _issue(component: str, code: str, severity: str, path: str, test: str) -> str:
    """An issue struct where the test holds; path is SQL."""
    return f"if(coalesce({test}, false), named_struct('component', {lit(component)}, 'code', '{code}', 'severity', '{severity}', 'path', {path}), NULL)"


def _rows(found: DataFrame, *lists: str) -> DataFrame:
    """Issue rows out of SQL arrays of issue structs."""
    none = "cast(array() AS array<struct<component:string,code:string,severity:string,path:string>>)"
    return found.selectExpr("report_id", f"inline(array_compact(concat({none}, {', '.join(lists)})))")


def _each(items: str, var: str, issues: list[str]) -> str:
    """Issues of every entry that is an object; i is its place."""
    return f"flatten(transform({items}, ({var}, i) -> if(try_variant_get({var}, '$', 'map<string,variant>') IS NULL, array(), array({', '.join(issues)}))))"


SUMMARY = "components.creditAccountsSummary"
ACCOUNTS = "components.accounts.accounts"


def validation_issues(found: DataFrame) -> DataFrame:
    """report_id, component, code, severity, path: what the shape of each component lacks."""
    missing = [("reportConfirmationDetails", "missing_confirmation_number", "confirmationNumber"), ("reportConfirmationDetails", "missing_report_date", "reportDate"),
               ("personalInformation", "missing_personal_name", "name")]
    top = [_issue(c, code, "error", lit(f"components.{c}.{f}"), f"coalesce({text_at(f'components.{c}.{f}')}, '') = ''") for c, code, f in missing]
    shapes = [("creditAccountsSummary", "invalid_summary_schema", SUMMARY), ("accounts", "invalid_accounts_schema", ACCOUNTS), ("publicRecords", "invalid_public_records_schema", "components.publicRecords.records"),
              ("collections", "invalid_collections_list", "components.collections.collections")]
    top += [_issue(c, code, "error", lit(path), f"NOT {_is_list(path)}") for c, code, path in shapes]
    top.append(_issue("inquiries", "invalid_inquiry_lists", "error", "'components.inquiries'", f"NOT ({_is_list('components.inquiries.hardInquiries')} AND {_is_list('components.inquiries.softInquiries')})"))
    top.append(_issue("creditAccountsSummary", "invalid_row_count", "error", lit(SUMMARY), f"{_is_list(SUMMARY)} AND size({_items(SUMMARY)}) <> {len(vocab.SUMMARY_TYPES)}"))
    types = f"array({', '.join(lit(t) for t in vocab.SUMMARY_TYPES)})"
    order = _issue("creditAccountsSummary", "invalid_row_order", "error", f"concat('{SUMMARY}[', i, '].accountType')", f"NOT coalesce({_get('accountType', 'string', f'get({_items(SUMMARY)}, i)')} = t, false)")
    rows = f"if({_is_list(SUMMARY)}, transform({types}, (t, i) -> {order}), array())"
    at = f"concat('{ACCOUNTS}[', i, ']"
    of_account = [_issue("accounts", "invalid_history_rows", "error", f"{at}.{h}')", f"NOT {_is_list(h, 'a')} OR size({_items(h, 'a')}) > 3") for h in HISTORIES]
    paid = f"size({_items('paymentHistory', 'a')})"
    of_account.append(_issue("accounts", "invalid_payment_history_length", "error", f"{at}.paymentHistory')", f"{paid} < 12 OR {paid} % 12 <> 0"))
    entries = _issue("accounts", "invalid_account_entry", "error", f"{at}')", "try_variant_get(a, '$', 'map<string,variant>') IS NULL")
    return _rows(found, f"array({', '.join(top)})", rows, f"transform({_items(ACCOUNTS)}, (a, i) -> {entries})", _each(_items(ACCOUNTS), "a", of_account))


def count_issues(found: DataFrame) -> DataFrame:
    """report_id, component, code, severity, path: counts a payload states that its lists do not bear out.

    A stated total of accounts counts only where the summary tells closed from open or a total from the open ones.
    """
    total = f"element_at(filter({_items(SUMMARY)}, s -> lower({_get('accountType', 'string', 's')}) = 'total'), 1)"
    with_total = found.selectExpr("report_id", "body", f"if(size(filter({_items(SUMMARY)}, s -> lower({_get('accountType', 'string', 's')}) = 'total')) > 0, {total}, NULL) AS t")
    stated = _digits("totalAccounts", "t")
    closed = f"if({text_at('closed', 't')} IN ('', 'Not reported'), NULL, {_digits('closed', 't')})"
    enforced = f"{stated} > 0 AND ({closed} IS NOT NULL OR {stated} <> {_digits('open', 't')})"
    other = "components.otherItemsSummary"
    inquiries = " + ".join(f"coalesce({_get(f'components.inquiries.{k}InquiryCount', 'bigint')}, 0)" for k in ("hard", "soft"))
    checks = [("accounts", f"{enforced} AND {stated} <> size({_items(ACCOUNTS)})"),
              *((c, f"{_int(f'{other}.{field}')} > 0 AND {_int(f'{other}.{field}')} <> {n}") for c, field, n in (
                  ("collections", "collectionCount", f"size({_items('components.collections.collections')})"),
                  ("publicRecords", "publicRecordCount", f"size({_items('components.publicRecords.records')})"), ("inquiries", "inquiryCount", f"({inquiries})")))]
    return _rows(with_total, f"array({', '.join(_issue(c, 'cross_component_mismatch', 'error', lit('components.' + c), test) for c, test in checks)})")


def quality_issues(found: DataFrame) -> DataFrame:
    """report_id, component, code, severity, path: what a reviewer of the extraction has to look at.

    One layout has checks of its own; all others share the rest.
    """
    new = f"profile_id = '{NEW}'"
    listed = f"size({_items(ACCOUNTS)})"
    every = [_issue("reportConfirmationDetails", "required_field_missing", "critical", lit(f"components.reportConfirmationDetails.{f}"), _empty(f"components.reportConfirmationDetails.{f}")) for f in ("confirmationNumber", "reportDate")]
    every.append(_issue("accounts", "empty_accounts", "critical", lit(ACCOUNTS), f"{listed} = 0"))

    def without(test: str) -> str:
        return f"size(filter({_items(ACCOUNTS)}, a -> coalesce({test}, false)))"

    def some(code: str, field: str, n: str, only: str) -> list[str]:
        path = lit(f"{ACCOUNTS}[*].{field}")
        return [_issue("accounts", code, "critical", path, f"{only} AND {listed} > 0 AND {n} = {listed}"), _issue("accounts", code, "warning", path, f"{only} AND {n} > 0 AND {n} < {listed}")]

    speechless = f"size(filter(transform({_items('contact', 'a')}, c -> {norm_text("try_variant_get(c, '$', 'string')")}), c -> c <> '')) = 0"
    contact = f"if({_is_list('contact', 'a')}, {speechless}, {_empty('contact', 'a')})"
    every += some("missing_contact_information", "address", without(f"{_empty('address', 'a')} AND {_empty('phoneNumber', 'a')}"), new)
    every += some("missing_contact_information", "contact", without(contact), f"NOT {new}")
    every.append(_issue("accounts", "missing_payment_history", "critical", lit(f"{ACCOUNTS}[*].paymentHistory"), f"{new} AND {listed} > 0 AND {without(f'size({_items("paymentHistory", "a")}) = 0')} = {listed}"))
    undated = without(" AND ".join(one_of(match_text(text_at(f, "a")), PLACEHOLDERS) for f in ("openDate", "dateOpened")))
    every.append(_issue("accounts", "missing_key_dates", "error", lit(f"{ACCOUNTS}[*].openDate"), f"NOT {new} AND {listed} > 0 AND {undated} = {listed}"))
    every.append(_issue("summary", "required_field_missing", "error", "'components.summary.accountsWithNegativeInfo'", f"NOT {new} AND {text_at('components.summary.accountsWithNegativeInfo')} IS NULL"))
    for f in ("oldestAccount", "recentAccount"):
        held = f"size(coalesce({_get(f'components.summary.{f}', 'map<string,variant>')}, cast(map() AS map<string,variant>))) > 0"
        every.append(_issue("summary", "invalid_date", "error", lit(f"components.summary.{f}.openDate"), f"NOT {new} AND {held} AND NOT coalesce({match_text(text_at(f'components.summary.{f}.openDate'))} RLIKE {rx(DAY)}, false)"))

    rows = _items(SUMMARY)
    five = f"({_is_list(SUMMARY)} AND size({rows}) = 5)"
    every.append(_issue("creditAccountsSummary", "invalid_row_count", "critical", lit(SUMMARY), f"NOT {new} AND NOT {five}"))
    values = "array(" + ", ".join(f"coalesce({text_at(c, 's')}, '~')" for c in SUMMARY_COLUMNS) + ")"
    every.append(_issue("creditAccountsSummary", "duplicated_rows", "critical", lit(SUMMARY), f"NOT {new} AND {five} AND size(array_distinct(transform(slice({rows}, 2, 3), s -> {values}))) = 1"))
    types = f"array({', '.join(lit(t) for t in vocab.SUMMARY_TYPES)})"
    of_row = [_issue("creditAccountsSummary", "invalid_row_order", "error", f"concat('{SUMMARY}[', i, '].accountType')", f"NOT coalesce({_get('accountType', 'string', 's')} = {types}[i], false)"),
              _issue("creditAccountsSummary", "count_logic_error", "error", f"concat('{SUMMARY}[', i, '].withBalance')", f"{_digits('withBalance', 's')} > {_digits('totalAccounts', 's')}")]
    of_rows = f"if(NOT {new} AND {five}, flatten(transform({rows}, (s, i) -> array({', '.join(of_row)}))), array())"

    at = f"concat('{ACCOUNTS}[', i, ']"
    of_account = [
        _issue("accounts", "contaminated_value", "error", f"{at}.accountName')", _has_phrase("accountName", FOREIGN_PHRASES, "a")),
        _issue("accounts", "contaminated_value", "error", f"{at}.status')", _has_phrase("status", ["available credit", "account history"], "a")),
        _issue("accounts", "contaminated_value", "error", f"{at}.loanType')", _has_phrase("loanType", ["date closed"], "a"))]

    def headers(field: str) -> str:
        texts = f"filter(if({_is_list(field, 'a')}, transform({_items(field, 'a')}, x -> {norm_text("try_variant_get(x, '$', 'string')")}), array({norm_text(text_at(field, 'a'))})), x -> x <> '')"
        issue = _issue("accounts", "contaminated_value", "critical", f"{at}.{field}[', j, ']')", one_of("lower(x)", SECTION_HEADERS))
        return f"flatten(transform({_items(ACCOUNTS)}, (a, i) -> if(try_variant_get(a, '$', 'map<string,variant>') IS NULL, array(), transform({texts}, (x, j) -> {issue}))))"

    held = _items("components.collections.collections")
    of_collection = [_issue("collections", "contaminated_value", "error", "concat('components.collections.collections[', i, '].collectionAgency')", _has_phrase("collectionAgency", FOREIGN_PHRASES, "c")),
                     _issue("collections", "contaminated_value", "error", "concat('components.collections.collections[', i, '].status')", _has_phrase("status", ["date of first delinquency"], "c"))]
    every.append(_issue("collections", "missing_required_fields", "error", "'components.collections.collections[*].collectionAgency'", f"NOT {new} AND size(filter({held}, c -> {_empty('collectionAgency', 'c')})) > 0"))
    stated = _digits("components.otherItemsSummary.inquiryCount", "body")
    every.append(_issue("inquiries", "count_mismatch", "critical", "'components.inquiries'", f"NOT {new} AND {stated} > 0 AND size({_items('components.inquiries.hardInquiries')}) + size({_items('components.inquiries.softInquiries')}) = 0"))
    states = "transform_values(coalesce(try_variant_get(body, '$.componentStatus', 'map<string,variant>'), cast(map() AS map<string,variant>)), (k, s) -> coalesce(try_variant_get(s, '$.status', 'string'), try_variant_get(s, '$', 'string')))"
    failed = f"transform(map_keys(map_filter({states}, (k, s) -> s = 'failed')), k -> named_struct('component', k, 'code', 'component_failed', 'severity', 'error', 'path', concat('components.', k)))"
    others = f"if({new}, array(), concat({_each(_items(ACCOUNTS), 'a', of_account)}, {headers('comments')}, {headers('contact')}, {_each(held, 'c', of_collection)}))"
    return _rows(found, f"array({', '.join(every)})", of_rows, others, failed)
