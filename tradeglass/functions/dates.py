"""Dates read from display text, and month arithmetic on m = year*12 + month-1."""

from __future__ import annotations

from tradeglass import vocab
from tradeglass.functions.text import lookup, missing, norm_text, rx

DAY_PATTERNS = [
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b",
]
DATE_PATTERNS = [*DAY_PATTERNS, r"\b[A-Za-z]{3,9}\s+\d{4}\b"]
WORD_YEAR = rx(r"([A-Za-z]+)\s+(\d{4})")
SLASH_YEAR = rx(r"(?<![\d/])(\d{1,2})/(\d{4})(?!\d)")
MDY = rx(r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$")
ISO = rx(r"^\d{4}-\d{2}-\d{2}$")
FULL = rx(r"^([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$")


def _date(y: str, m: str, d: str) -> str:
    return f"try_cast(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS date)"


def read_date(t: str) -> str:
    """Date of a normalised text: month-year (first of month), M/D/Y with pivot year 70, ISO,
    and 'Mon D, YYYY'; else null. A slash month-year counts only when it is not the tail of a full date.
    """
    def part(pattern: str, i: int) -> str:
        return f"regexp_extract({t}, {pattern}, {i})"

    def month(pattern: str) -> str:
        return f"cast({lookup(f'lower({part(pattern, 1)})', vocab.MONTH_NAMES)} AS string)"

    short = part(MDY, 3)
    year = f"if(length({short}) = 2, concat(if({short} >= '70', '19', '20'), {short}), {short})"
    return (
        f"CASE WHEN {missing(t)} THEN NULL WHEN {t} RLIKE {MDY} THEN {_date(year, part(MDY, 1), part(MDY, 2))} "
        f"WHEN {t} RLIKE {ISO} THEN try_cast({t} AS date) "
        f"ELSE coalesce({_date(part(WORD_YEAR, 2), month(WORD_YEAR), "'1'")}, "
        f"{_date(part(SLASH_YEAR, 2), part(SLASH_YEAR, 1), "'1'")}, "
        f"{_date(part(FULL, 3), month(FULL), part(FULL, 2))}) END"
    )


def parse_date(c: str) -> str:
    return read_date(norm_text(c))


def _first_match(t: str, patterns: list[str]) -> str:
    hits = ", ".join(f"nullif(regexp_extract({t}, {rx(p)}, 0), '')" for p in patterns)
    return f"coalesce({hits}, '')"


def date_text(c: str) -> str:
    return _first_match(norm_text(c), DATE_PATTERNS)


def day_text(c: str) -> str:
    return _first_match(norm_text(c), DAY_PATTERNS)


def read_day(t: str) -> str:
    """Day-level date printed anywhere in a normalised text, else null."""
    mdy, iso, full = (f"regexp_extract({t}, {rx(p)}, 0)" for p in DAY_PATTERNS)
    year = f"substring_index({mdy}, '/', -1)"
    year4 = f"if(length({year}) = 2, concat(if({year} >= '70', '19', '20'), {year}), {year})"
    parts = f"split({mdy}, '/')"
    words = f"split(replace({full}, ',', ''), ' +')"
    month = f"cast({lookup(f'lower(get({words}, 0))', vocab.MONTH_NAMES)} AS string)"
    return (f"CASE WHEN {mdy} <> '' THEN {_date(year4, f'get({parts}, 0)', f'get({parts}, 1)')} "
            f"WHEN {iso} <> '' THEN try_cast({iso} AS date) "
            f"WHEN {full} <> '' THEN {_date(f'get({words}, 2)', month, f'get({words}, 1)')} END")


def parse_day(c: str) -> str:
    return read_day(norm_text(c))


def month_index(d: str) -> str:
    return f"cast(year({d}) * 12 + month({d}) - 1 AS int)"


def month_start(m: str) -> str:
    return f"make_date(cast(floor({m} / 12) AS int), cast({m} % 12 + 1 AS int), 1)"


def month_label(m: str) -> str:
    names = ", ".join(f"'{x}'" for x in vocab.MONTHS)
    return f"concat(element_at(array({names}), cast({m} % 12 + 1 AS int)), ' ', cast(floor({m} / 12) AS string))"


def months_between(a: str, b: str) -> str:
    return f"({month_index(b)} - {month_index(a)})"
