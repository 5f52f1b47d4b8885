"""Account classification predicates as Spark SQL expressions."""

from __future__ import annotations

import re

from tradeglass import vocab
from tradeglass.functions.text import contains_any, either, institution_key, joined, lit, match_text, missing, norm_text, rx


def collection_status(*cols: str) -> str:
    return contains_any(joined(*cols), vocab.COLLECTION_WORDS)


def derogatory_status(status: str) -> str:
    return contains_any(match_text(status), vocab.DEROGATORY_WORDS)


def plan_context(*cols: str) -> str:
    return contains_any(joined(*cols), vocab.PLAN_WORDS)


def installment_like(*cols: str) -> str:
    return contains_any(joined(*cols), vocab.INSTALLMENT_WORDS)


def revolving_like(*cols: str) -> str:
    return contains_any(joined(*cols), vocab.REVOLVING_WORDS)


def student_servicer(name: str, original_creditor: str) -> str:
    return contains_any(joined(name, original_creditor), vocab.STUDENT_SERVICER_WORDS)


def student_loan_like(type_: str, category: str, name: str, original_creditor: str) -> str:
    kind = joined(type_, category)
    return (f"CASE WHEN {contains_any(kind, vocab.NON_STUDENT_WORDS)} THEN false "
            f"WHEN {contains_any(kind, vocab.STUDENT_TYPE_WORDS)} THEN true "
            f"ELSE {student_servicer(name, original_creditor)} END")


def usable_creditor(original: str, name: str, type_: str, category: str, status: str, comments: str) -> str:
    """The original creditor is stated, or the account's own name can stand for it."""
    context = joined(name, type_, category, status, comments)
    student = f"({student_loan_like(type_, category, name, original)} AND {student_servicer(name, original)})"
    return (f"(NOT {missing(norm_text(original))} OR (NOT {contains_any(context, vocab.THIRD_PARTY_WORDS)} "
            f"AND NOT {student} AND length({institution_key(name)}) >= 4))")


def display_text_negative(c: str) -> str:
    t = f"lower(trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[_-]+', ' '), {rx('\\s+')}, ' ')))"
    return (f"({t} RLIKE {rx(either(vocab.HARD_NEGATIVE))} OR ({t} RLIKE {rx(either(vocab.SOFT_NEGATIVE))} "
            f"AND NOT {t} RLIKE {rx(either(vocab.NEGATIVE_OVERRIDE))}))")


def display_code_negative(c: str) -> str:
    codes = ", ".join(lit(x) for x in vocab.DISPLAY_NEGATIVE_CODES)
    return f"(upper({norm_text(c)}) IN ({codes}))"


def account_subtype(context: str) -> str:
    tests = " ".join(f"WHEN {context} RLIKE {rx(either(p))} THEN '{label}'" for label, _, p in vocab.SUBTYPES)
    return f"CASE {tests} END"


def legal_category(context: str) -> str:
    """Category of the first subtype that matches, else bankruptcy when the context says so."""
    tests = " ".join(f"WHEN {context} RLIKE {rx(either(p))} THEN {lit(legal) if legal else 'NULL'}"
                     for _, legal, p in vocab.SUBTYPES)
    return f"coalesce(CASE {tests} END, if({context} RLIKE {rx(either(vocab.BANKRUPTCY_CONTEXT))}, 'bankruptcy', NULL))"


def reporting_category(context: str) -> str:
    return f"if({context} RLIKE {rx(either(vocab.COLLECTION_CONTEXT))}, 'collection', 'tradeline')"


def bureau_of(text: str) -> str:
    t = f"lower({text})"
    return (f"CASE WHEN contains({t}, 'equifax') OR (contains({t}, 'report confirmation') AND contains({t}, 'confirmation number')) "
            f"OR (contains({t}, 'report date') AND contains({t}, 'credit file status')) THEN 'Equifax' "
            f"WHEN contains({t}, 'experian') THEN 'Experian' WHEN contains({t}, 'transunion') THEN 'TransUnion' "
            f"ELSE 'Unknown' END")


def layout_of(text: str) -> str:
    """Layout profile named by the words printed on the report; null when none fit."""
    t = f"lower({text})"

    def all_of(*words: str) -> str:
        return "(" + " AND ".join(f"contains({t}, '{w}')" for w in words) + ")"

    tests = " ".join(f"WHEN {' OR '.join(all_of(*words) for words in ways)} THEN '{layout}'" for layout, ways in vocab.LAYOUT_PHRASES)
    return f"CASE {tests} END"


def _literal_cores(patterns: list[str]) -> list[str]:
    """A literal every match of each alternative must contain, in lower case; [] when one has none."""
    cores = [re.split(r".\?|[(\[^$*+]", alt.replace(r"\b", ""))[0].strip().lower() for alt in patterns]
    return cores if all(cores) else []


def section_present(text: str, section: str) -> str:
    """Section heading test; plain substring tests run first, so most texts never meet the pattern."""
    patterns = vocab.SECTION_PATTERNS[section]
    flags = "(?im)" if patterns[0].startswith("^") else "(?i)"
    cores = _literal_cores(patterns) or ["additional information"]
    maybe = " OR ".join(f"contains(lower({text}), {lit(c)})" for c in cores)
    return f"(({maybe}) AND {text} RLIKE {rx(flags + either(patterns))})"
