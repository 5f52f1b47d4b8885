"""The evaluated account view: one row per tradeline, resolved from raw fields and history facts.

Layouts differ only in which raw keys feed a field and in which order, so they are
data (FIELD_CHAINS), not code. A chain entry is a raw key, or one of
  @name            a history fact column
  date:key         date text inside a raw value
  date:@name       date text inside a history fact
  past_due:key     first amount of a raw value that mentions "past due"
  charge_off:key   first amount of a raw value that mentions a charge-off
  limit:key        first amount of a raw value that mentions a credit limit
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tradeglass import vocab
from tradeglass.functions import classify, dates
from tradeglass.functions.money import amount, amount_max, field_state, money_in_context, positive_int, reported
from tradeglass.functions.text import (
    add, add_needed, contains_any, incomplete_number, lit, match_text, missing, names_in, needed, norm_text, unique_ci,
)
from tradeglass.operators.history import FACT_NAMES, KEY, account_facts
from tradeglass.operators.timing import PAYMENT_FIELDS, REPORTING_FIELDS, field_days, late_intervals

# --- fixed values: ordered source keys per layout ------------------------------
OLD, EXP, NEW, TU = vocab.LAYOUTS
FIELD_CHAINS: dict[str, dict[str, list[str]]] = {
    "type": {
        OLD: ["accountType", "creditType", "loanType", "accountInfo.accountType", "accountInfo.loanType"],
        EXP: ["accountInfo.accountType", "accountInfo.accountCategory"],
        NEW: ["loanAccountType", "accountType"],
        TU: ["accountInfo.accountType", "accountInfo.loanType"],
    },
    "category": {
        OLD: ["accountCategory", "loanType", "creditorClassification", "accountInfo.accountCategory",
              "accountInfo.loanType"],
        EXP: ["accountInfo.loanType", "accountInfo.accountCategory"],
        NEW: ["owner", "accountType", "activityDesignator"],
        TU: ["accountInfo.loanType", "sectionType"],
    },
    "status": {
        OLD: ["accountStatus", "status", "paymentStatus", "accountInfo.status", "accountInfo.accountStatus",
              "historicalInfo.status"],
        EXP: ["accountInfo.status"],
        NEW: ["status", "activityDesignator"],
        TU: ["accountInfo.payStatus", "accountInfo.accountStatus", "accountStatus", "status"],
    },
    "responsibility": {
        OLD: ["responsibility", "accountOwnership", "paymentResponsibility", "accountInfo.responsibility"],
        EXP: ["accountInfo.responsibility"],
        NEW: ["owner"],
        TU: ["accountInfo.responsibility"],
    },
    "address": {
        OLD: ["address", "contactInfo.address", "accountInfo.address"],
        EXP: ["contactInfo.address"],
        NEW: ["address"],
        TU: ["contactInfo.address", "accountInfo.address"],
    },
    "phone": {
        OLD: ["phoneNumber", "contactInfo.phoneNumber", "accountInfo.phoneNumber"],
        EXP: ["contactInfo.phoneNumber"],
        NEW: ["phoneNumber"],
        TU: ["contactInfo.phoneNumber", "accountInfo.phoneNumber"],
    },
    "date_opened": {
        OLD: ["dateOpened", "openDate", "accountInfo.dateOpened", "historicalInfo.dateOpened"],
        EXP: ["accountInfo.dateOpened"],
        NEW: ["dateOpened"],
        TU: ["accountInfo.dateOpened"],
    },
    "date_reported": {
        OLD: ["dateReported", "delinquencyFirstReported", "accountInfo.dateReported", "accountInfo.dateUpdated",
              "historicalInfo.dateReported"],
        EXP: ["accountInfo.statusUpdated", "historicalInfo.statusUpdated", "accountInfo.balanceUpdated",
              "historicalInfo.balanceUpdated"],
        NEW: ["dateReported"],
        TU: ["accountInfo.dateUpdated"],
    },
    "date_closed": {
        OLD: ["dateClosed", "accountInfo.dateClosed", "historicalInfo.dateClosed"],
        EXP: ["accountInfo.dateClosed"],
        NEW: ["dateClosed"],
        TU: ["accountInfo.dateClosed"],
    },
    "status_updated": {
        OLD: ["statusUpdated", "accountInfo.statusUpdated", "dateReported", "delinquencyFirstReported",
              "accountInfo.dateReported", "accountInfo.dateUpdated", "historicalInfo.dateReported"],
        EXP: ["accountInfo.statusUpdated", "historicalInfo.statusUpdated"],
        NEW: ["dateReported", "dateOfLastActivity"],
        TU: ["accountInfo.dateUpdated"],
    },
    "balance_updated": {
        OLD: ["balanceUpdated", "accountInfo.balanceUpdated", "dateOfLastActivity", "dateReported",
              "delinquencyFirstReported", "accountInfo.dateReported", "accountInfo.dateUpdated",
              "historicalInfo.dateReported"],
        EXP: ["accountInfo.balanceUpdated", "historicalInfo.balanceUpdated"],
        NEW: ["dateOfLastActivity", "dateReported"],
        TU: ["accountInfo.dateUpdated"],
    },
    "stated_last_payment": {
        OLD: ["lastPaymentDate", "dateOfLastPayment", "accountInfo.lastPaymentDate", "accountInfo.lastPaymentMade",
              "historicalInfo.lastPaymentDate"],
        EXP: ["historicalInfo.lastPaymentDate", "accountInfo.lastPaymentDate"],
        NEW: ["dateOfLastPayment"],
        TU: ["accountInfo.lastPaymentMade"],
    },
    "last_payment": {
        OLD: ["lastPaymentDate", "dateOfLastPayment", "accountInfo.lastPaymentDate", "accountInfo.lastPaymentMade",
              "historicalInfo.lastPaymentDate", "date:accountInfo.recentPayment", "date:@paid_last"],
        EXP: ["historicalInfo.lastPaymentDate", "accountInfo.lastPaymentDate", "date:accountInfo.recentPayment",
              "date:@paid_last"],
        NEW: ["dateOfLastPayment", "@last_payment_date_last"],
        TU: ["accountInfo.lastPaymentMade", "date:accountInfo.paymentReceived", "date:@paid_last"],
    },
    "payment_amount": {
        OLD: ["paymentAmount", "scheduledPaymentAmount", "actualPaymentAmount", "accountInfo.monthlyPayment",
              "accountInfo.paymentReceived", "@scheduled_pos", "@paid_pos"],
        EXP: ["accountInfo.monthlyPayment", "@scheduled_pos"],
        NEW: ["actualPaymentAmount", "scheduledPaymentAmount", "@paid_pos"],
        TU: ["accountInfo.monthlyPayment", "@scheduled_pos", "accountInfo.paymentReceived", "@paid_last"],
    },
    "recent_payment": {
        OLD: ["actualPaymentAmount", "paymentAmount", "accountInfo.paymentReceived", "accountInfo.recentPayment",
              "@paid_last"],
        EXP: ["accountInfo.recentPayment", "@paid_last"],
        NEW: ["actualPaymentAmount", "@paid_pos"],
        TU: ["accountInfo.paymentReceived", "@paid_last"],
    },
    "past_due": {
        OLD: ["amountPastDue", "accountInfo.amountPastDue", "@past_due_pos"],
        EXP: ["accountInfo.amountPastDue", "historicalInfo.amountPastDue", "past_due:accountInfo.status"],
        NEW: ["amountPastDue", "@past_due_pos"],
        TU: ["accountInfo.amountPastDue", "@past_due_pos"],
    },
    "charge_off": {
        OLD: ["chargeOffAmount", "accountInfo.chargeOffAmount", "historicalInfo.chargeOffAmount",
              "charge_off:=status"],
        EXP: ["accountInfo.chargeOffAmount", "historicalInfo.chargeOffAmount", "charge_off:accountInfo.status"],
        NEW: ["chargeOffAmount"],
        TU: ["accountInfo.chargeOffAmount", "charge_off:accountInfo.payStatus"],
    },
    "credit_limit": {
        OLD: ["creditLimit", "accountInfo.creditLimit", "@credit_limit_pos", "limit:accountInfo.creditLimitHistory"],
        EXP: ["accountInfo.creditLimit"],
        NEW: ["creditLimit", "@credit_limit_pos"],
        TU: ["accountInfo.creditLimit", "limit:accountInfo.creditLimitHistory", "@credit_limit_pos"],
    },
    "high_balance": {
        OLD: ["highestBalance", "highCredit", "accountInfo.highestBalance", "accountInfo.highCredit",
              "@balance_top"],
        EXP: ["accountInfo.highestBalance", "@balance_top"],
        NEW: ["highCredit", "highBalance", "@high_credit_top", "@balance_top"],
        TU: ["accountInfo.highBalance", "accountInfo.highCredit", "@high_credit_top", "@balance_top"],
    },
    "original_creditor": {
        OLD: ["originalCreditorName", "accountInfo.originalCreditor", "accountInfo.originalCreditorName",
              "historicalInfo.originalCreditor"],
        EXP: ["accountInfo.originalCreditor", "historicalInfo.originalCreditor"],
        NEW: ["originalCreditorName"],
        TU: ["accountInfo.originalCreditor"],
    },
    "first_delinquency": {
        OLD: ["dateOfFirstDelinquency", "delinquencyFirstReported", "accountInfo.dateOfFirstDelinquency",
              "historicalInfo.dateOfFirstDelinquency"],
        EXP: ["historicalInfo.dateOfFirstDelinquency"],
        NEW: ["dateOfFirstDelinquency", "dateMajorDelinquencyFirstReported"],
        TU: ["accountInfo.dateOfFirstDelinquency"],
    },
    "removal": {
        OLD: ["onRecordUntil", "estimatedRemoval", "accountInfo.onRecordUntil", "accountInfo.estimatedRemoval",
              "historicalInfo.onRecordUntil", "historicalInfo.estimatedRemoval"],
        EXP: ["accountInfo.onRecordUntil", "historicalInfo.onRecordUntil", "historicalInfo.estimatedRemoval"],
        NEW: ["onRecordUntil"],
        TU: ["accountInfo.estimatedRemoval"],
    },
    "terms": {
        OLD: ["termsFrequency", "accountInfo.termsFrequency", "accountInfo.terms"],
        EXP: ["accountInfo.terms"],
        NEW: ["termsFrequency"],
        TU: ["accountInfo.terms"],
    },
    "duration": {
        OLD: ["termDuration", "accountInfo.termDuration", "accountInfo.terms"],
        EXP: ["accountInfo.termDuration", "accountInfo.terms"],
        NEW: ["termDuration"],
        TU: ["accountInfo.termDuration", "accountInfo.terms"],
    },
    "months_reviewed": {
        OLD: ["monthsReviewed", "accountInfo.monthsReviewed"],
        EXP: ["historicalInfo.monthsReviewed", "accountInfo.monthsReviewed"],
        NEW: ["monthsReviewed"],
        TU: ["accountInfo.monthsReviewed"],
    },
}
MONEY_STATES: dict[str, dict[str, list[str]]] = {
    "balance_state": {
        OLD: ["currentBalance", "balance", "accountInfo.balance"],
        EXP: ["accountInfo.balance"], NEW: ["balance"], TU: ["accountInfo.balance"],
    },
    "payment_state": {
        OLD: ["actualPaymentAmount", "accountInfo.paymentReceived", "accountInfo.recentPayment"],
        EXP: ["accountInfo.recentPayment"], NEW: ["actualPaymentAmount"], TU: ["accountInfo.paymentReceived"],
    },
    "scheduled_state": {
        OLD: ["scheduledPaymentAmount", "accountInfo.scheduledPaymentAmount", "accountInfo.monthlyPayment"],
        EXP: ["accountInfo.monthlyPayment"], NEW: ["scheduledPaymentAmount"], TU: ["accountInfo.monthlyPayment"],
    },
}
CLOSED_KEYS = {OLD: ["activityDesignator"], EXP: [], NEW: ["status", "activityDesignator"],
               TU: ["accountInfo.payStatus", "accountInfo.remarks"]}
# Fields that never fall back on history, so they are known before the history pass.
ANCHOR_FIELDS = ["status", "date_opened", "date_closed", "status_updated", "balance_updated", "stated_last_payment"]


def by_layout(build: Callable[[str], str]) -> str:
    """One expression per layout, chosen by profile_id; unknown profiles read as the first layout."""
    cases = " ".join(f"WHEN '{layout}' THEN {build(layout)}" for layout in (EXP, NEW, TU))
    return f"CASE profile_id {cases} ELSE {build(OLD)} END"


def _keys(keys: list[str]) -> str:
    return f"array({', '.join(lit(k) for k in keys)})" if keys else "cast(array() AS array<string>)"


def _first_of(keys: str) -> str:
    """First non-empty value of an ordered key array; raw_text is the normalised field map."""
    return f"get(filter(transform({keys}, k -> raw_text[k]), v -> v <> ''), 0)"


def _special(entry: str) -> bool:
    return entry[0] in "@=" or ":" in entry


def _entry(entry: str) -> str:
    if entry[0] in "@=":
        return entry[1:]
    if ":" in entry:
        kind, source = entry.split(":", 1)
        words = {"past_due": ["past due"], "charge_off": ["charge off", "charged off"], "limit": ["credit limit"]}
        return dates.date_text(_entry(source)) if kind == "date" else money_in_context(_entry(source), words[kind])
    return f"raw_text['{entry}']"


def _chain(entries: list[str]) -> str:
    parts, keys = [], []
    for e in [*entries, "@"]:
        if not _special(e):
            keys.append(e)
            continue
        if keys:
            parts.append(_first_of(_keys(keys)))
            keys = []
        if e != "@":
            parts.append(f"nullif({_entry(e)}, '')")
    return f"coalesce({', '.join(parts)}, '')"


def field(name: str) -> str:
    """First non-empty value of the layout's chain, else ''."""
    chains = FIELD_CHAINS[name]
    if any(_special(e) for chain in chains.values() for e in chain):
        return by_layout(lambda layout: _chain(chains[layout]))
    return f"coalesce({_first_of(by_layout(lambda layout: _keys(chains[layout])))}, '')"


def money_state(name: str) -> str:
    return field_state("raw_text", by_layout(lambda layout: _keys(MONEY_STATES[name][layout])))


def _closed() -> str:
    """Closed flag, date, or wording; each layout words it in its own fields."""
    def words(layout: str) -> str:
        if layout == EXP:
            return f"contains(lower({_entry('accountInfo.status')}), 'closed')"
        texts = [_entry(k) for k in CLOSED_KEYS[layout]] + ([] if layout == TU else ["status", "comments_text"])
        return contains_any(f"lower(concat_ws(' ', {', '.join(texts)}))", vocab.CLOSED_WORDS)

    flag = "coalesce(raw_text['isClosed'] = 'true', false)"
    return f"({flag} OR NOT {missing('date_closed')} OR coalesce({by_layout(words)}, false))"


def entity_key(name: str, number: str) -> str:
    return f"concat({match_text(name)}, '::', {norm_text(number)})"


TEXTS = {"subtype": "accountSubtype", "reporting_category": "reportingCategory", "legal_category": "legalCategory",
         "indicator": "consumerInformationIndicator", "additional": "additionalInformation",
         "statement": "consumerStatement", "reinvestigation": "reinvestigationInfo"}

# Known before the history pass: dates, status, closed state and closure month.
ANCHOR_LAYERS: list[dict[str, str]] = [
    {"raw_text": f"transform_values(raw, (k, v) -> {norm_text('v')})",
     "comments_text": f"array_join({unique_ci('coalesce(comments, cast(array() AS array<string>))')}, ' ')",
     "name": norm_text("account_name"), "number": norm_text("account_number")},
    {name: field(name) for name in ANCHOR_FIELDS},
    {"is_closed": _closed()},
    {"closure_timing": "if(is_closed, coalesce(nullif(date_closed, ''), nullif(status_updated, ''), balance_updated), '')"},
    {"closure_m": dates.month_index(
        f"coalesce({dates.read_date('closure_timing')}, {dates.read_date('stated_last_payment')})"),
     "opened_m": dates.month_index(dates.read_date("date_opened"))},
]
VIEW_LAYERS: list[dict[str, str]] = [
    {
        **{name: field(name) for name in FIELD_CHAINS if name not in ANCHOR_FIELDS},
        **{name: money_state(name) for name in MONEY_STATES},
        **{name: f"coalesce(raw_text['{key}'], '')" for name, key in TEXTS.items()},
    },
    {
        "context": f"lower(concat_ws(' ', name, type, category, {', '.join(TEXTS)}, status, comments_text, original_creditor))",
        "plan_text": "lower(concat_ws(' ', status, type, category, subtype, legal_category, comments_text, additional))",
        "kind_text": "lower(concat_ws(' ', status, name, type, category, comments_text))",
        "balance": "coalesce(nullif(balance_state.value, ''), balance_last, '')",
        "past_due_amt": amount("past_due"),
        "charge_off_amt": amount("charge_off"),
        "high_balance_amt": amount("high_balance"),
        "credit_limit_amt": amount("credit_limit"),
        "balance_reported": reported("balance_state"),
        "payment_reported": reported("payment_state"),
        "scheduled_reported": reported("scheduled_state"),
        "student_loan": classify.student_loan_like("type", "category", "name", "original_creditor"),
        "usable_creditor": classify.usable_creditor(
            "original_creditor", "name", "type", "category", "status", "comments_text"),
        "anchor_text": "coalesce(nullif(report_date, ''), nullif(date_reported, ''), nullif(status_updated, ''), "
                       f"{dates.month_label('last_seen_m')}, '')",
        "incomplete_number": incomplete_number("number"),
        "reviewed": positive_int("months_reviewed"),
        "payment_days": f"array_distinct(concat({field_days(PAYMENT_FIELDS)}, "
                        "coalesce(cell_pay_days, cast(array() AS array<int>))))",
        "reporting_days": field_days(REPORTING_FIELDS),
        **{f"{name}_m": dates.month_index(dates.read_date(name))
           for name in ("status_updated", "balance_updated", "last_payment", "first_delinquency", "removal")},
    },
    {
        "anchor_m": dates.month_index(dates.read_date("anchor_text")),
        "collection": f"(lower(reporting_category) = 'collection' OR "
                      f"{classify.collection_status('status', 'comments_text', 'additional')})",
        "installment": contains_any("kind_text", vocab.INSTALLMENT_WORDS),
        "revolving": contains_any("kind_text", vocab.REVOLVING_WORDS),
        "plan": contains_any("plan_text", vocab.PLAN_WORDS),
        "bankruptcy": contains_any("context", vocab.BANKRUPTCY_WORDS),
        "litigation": contains_any("context", vocab.LITIGATION_WORDS),
        "past_due_pos_flag": "coalesce(past_due_amt > 0, false)",
        "charge_off_pos": "coalesce(charge_off_amt > 0, false)",
        "present": "n_seen > 0",
        "only_current": "n_cur > 0 AND n_not_current = 0",
        "observed_balance_max": f"greatest({amount_max('balance')}, balance_max)",
        "lookback": "cast(if(student_loan AND reviewed > 84, reviewed, 84) AS int)",
        "signal_days": "array_union(payment_days, reporting_days)",
    },
    {
        "derogatory_status": f"({contains_any('lower(status)', vocab.DEROGATORY_WORDS)} OR collection "
                             "OR past_due_pos_flag OR charge_off_pos)",
        "intervals": late_intervals(),
        "expected_m": "if(opened_m IS NOT NULL AND anchor_m IS NOT NULL, "
                      "greatest(opened_m + 1, anchor_m - (lookback - 1)), NULL)",
    },
    {
        "negative": "derogatory_status OR bankruptcy OR n_der > 0",
        "n_interval_months": "size(intervals)",
        "n_short_intervals": "size(filter(intervals, x -> x.days IN (28, 29)))",
    },
]


def with_anchors(tradeline: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """Resolve the fields known before history, for accounts that have a name or a number."""
    identified = f"{norm_text('account_name')} <> '' OR {norm_text('account_number')} <> ''"
    return add_needed(tradeline.where(identified), ANCHOR_LAYERS, wanted)


def account_view(tradeline: DataFrame, cells: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """One typed row per account. Text columns keep the printed value; *_amt and *_m are parsed.

    wanted names the columns the caller reads; the rest is then never planned, and
    without history facts among them the cells are not read at all.
    """
    layers = needed(VIEW_LAYERS, wanted)
    names = FACT_NAMES if wanted is None else names_in(v for layer in layers for v in layer.values()) | wanted
    facts_wanted = set(FACT_NAMES & names)
    t = with_anchors(tradeline, None if wanted is None else names | (
        {"opened_m", "closure_m"} if facts_wanted else set()))
    if facts_wanted:
        facts = account_facts(cells, t.select(*KEY, "profile_id", "opened_m", "closure_m"), facts_wanted)
        t = t.join(facts, KEY, "left").fillna(0, [c for c in facts.columns if c.startswith("n_")])
    for layer in layers:
        t = add(t, layer) if layer else t
    return t
