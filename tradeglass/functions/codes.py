"""Payment-history codes: normal forms, predicates and severity ranks."""

from __future__ import annotations

from tradeglass import vocab
from tradeglass.functions.text import lookup, match_text, norm_text, one_of, rx


def conformed_code(c: str) -> str:
    """Comparison form of a code whose text is already normalised."""
    return f"replace(replace(translate(lower({c}), '<>', ''), '✓', 'ok'), '✔', 'ok')"


def history_code(c: str) -> str:
    """Comparison form of a printed code."""
    return conformed_code(match_text(c))


def is_blank(code: str) -> str:
    return one_of(code, vocab.BLANK_CODES)


def is_current(code: str) -> str:
    return one_of(code, vocab.CURRENT_CODES)


def is_derogatory(code: str) -> str:
    return one_of(code, vocab.DEROGATORY_CODES)


def is_severe(code: str) -> str:
    return one_of(code, vocab.SEVERE_CODES)


def is_charge_off(code: str) -> str:
    return one_of(code, vocab.CHARGE_OFF_CODES)


def severity_rank(code: str) -> str:
    return f"coalesce({lookup(code, vocab.SEVERITY_RANK)}, 0)"


def scanned_code(c: str) -> str:
    """Normal form of a scanned code, repairing common misreadings; '-' when unknown."""
    t = f"upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9]', ''))"
    return (f"CASE WHEN {one_of(t, list(vocab.STATUS_LEGEND))} THEN {t} WHEN {t} LIKE 'COL%' THEN 'COL' "
            f"WHEN {t} LIKE 'CO%' THEN 'CO' WHEN {t} LIKE 'OK%' OR {t} IN ('0K', 'DK', 'GK') THEN 'OK' "
            f"WHEN {t} LIKE 'TNT%' OR {t} = 'TN' THEN 'TNT' WHEN {t} IN ('3', '6', '9') THEN concat({t}, '0') "
            f"WHEN {t} LIKE '12%' THEN '120' WHEN {t} LIKE '15%' THEN '150' WHEN {t} LIKE '18%' THEN '180' ELSE '-' END")


def grid_token(c: str) -> str:
    """Normal form of one grid token: check marks and icon glyphs are OK, dashes are X, others null."""
    t = f"regexp_replace(trim(coalesce({c}, '')), '^,+|,+$', '')"
    return (f"CASE WHEN {t} = '' THEN NULL WHEN {t} RLIKE {rx('^[\\x{E000}-\\x{F8FF}]+$')} OR {t} IN ('✓', '✔') THEN 'OK' "
            f"WHEN {t} IN ('—', '-', '–') THEN 'X' WHEN {one_of(f'upper({t})', vocab.GRID_TOKENS)} THEN upper({t}) END")


def grid_tokens(c: str) -> str:
    """All recognised tokens of a cell that may hold several."""
    return f"filter(transform(split({norm_text(c)}, ' '), x -> {grid_token('x')}), x -> x IS NOT NULL)"


def any_meaningful(arr: str) -> str:
    return f"exists({arr}, x -> NOT {is_blank('x')})"


def any_derogatory(arr: str) -> str:
    return f"exists({arr}, x -> {is_derogatory('x')})"


def any_current(arr: str) -> str:
    return f"exists({arr}, x -> {is_current('x')})"


def only_current_or_blank(arr: str) -> str:
    return f"({any_current(arr)} AND forall({arr}, x -> {is_blank('x')} OR {is_current('x')}))"
