"""Money read from display text, kept as decimal(18,2) beside the text it came from."""

from __future__ import annotations

from tradeglass import vocab
from tradeglass.functions.text import contains_any, match_text, missing, norm_text, rx

PATTERN = rx(vocab.MONEY_PATTERN)


def _number(match: str) -> str:
    return f"try_cast(translate({match}, '$,', '') AS decimal(18,2))"


def _first(text: str) -> str:
    """The first match as a number; a text without any is null before the cast, which raises and catches an error for ''."""
    return _number(f"regexp_substr({text}, {PATTERN})")


def money_text(c: str) -> str:
    return f"regexp_extract({norm_text(c)}, {PATTERN}, 0)"


def money(c: str) -> str:
    """First amount in the text, null when there is none."""
    return _first(norm_text(c))


def amount(c: str) -> str:
    """money for normalised text."""
    return _first(c)


def money_all(c: str) -> str:
    hits = f"regexp_extract_all({norm_text(c)}, {PATTERN}, 0)"
    return f"filter(transform({hits}, x -> {_number('x')}), x -> x IS NOT NULL)"


def max_money(*cols: str) -> str:
    return f"array_max(flatten(array({', '.join(money_all(c) for c in cols)})))"


def amount_max(c: str) -> str:
    """Largest amount in a normalised text."""
    return f"array_max(transform(regexp_extract_all({c}, {PATTERN}, 0), x -> {_number('x')}))"


def money_in_context(c: str, words: list[str]) -> str:
    return f"if({contains_any(match_text(c), words)}, nullif({money_text(c)}, ''), NULL)"


def positive_int(c: str) -> str:
    return f"nullif(try_cast(regexp_extract({norm_text(c)}, {rx('\\d+')}, 0) AS bigint), 0)"


def field_state(raw: str, keys: str) -> str:
    """Value and state of a reported money field over an ordered key array of a normalised field map.

    value and zero win at the first candidate that has them; otherwise the first
    present candidate makes it explicit_not_reported; an absent key is different
    from a present empty one.
    """
    present = f"filter({keys}, k -> map_contains_key({raw}, k))"
    hit = f"get(filter(transform({keys}, k -> {raw}[k]), v -> NOT {missing('v')}), 0)"
    first = f"{raw}[get({present}, 0)]"
    return (f"CASE WHEN {hit} IS NOT NULL THEN named_struct('value', {hit}, 'state', "
            f"if(coalesce({amount(hit)} = 0, false), 'present_with_zero', 'present_with_value')) "
            f"WHEN size({present}) > 0 THEN named_struct('value', if({first} = '', 'Not reported', {first}), "
            f"'state', 'present_explicit_not_reported') "
            f"ELSE named_struct('value', '', 'state', 'missing_field') END")


def reported(state: str) -> str:
    return f"({state}.state IN ('present_with_value', 'present_with_zero'))"


def values_equal(a: str, b: str) -> str:
    """Equality across spellings: compact text, amounts within half a cent, or the same digits."""
    ta, tb = match_text(a), match_text(b)
    same = f"regexp_replace({ta}, '[^a-z0-9]', '') = regexp_replace({tb}, '[^a-z0-9]', '')"
    near = f"coalesce(abs({money(a)} - {money(b)}) < 0.005, false)"
    da, db = f"regexp_replace({ta}, '[^0-9.]', '')", f"regexp_replace({tb}, '[^0-9.]', '')"
    return f"({ta} <> '' AND {tb} <> '' AND ({same} OR {near} OR ({da} <> '' AND {da} = {db})))"


def money_display(c: str) -> str:
    """Dollar display: '-' for nothing, '$0' for zero, '-$n' for negatives, letters untouched."""
    t = f"trim({c})"
    return (f"CASE WHEN coalesce({c}, '') = '' THEN '-' WHEN {c} = '0' THEN '$0' WHEN {t} RLIKE '[A-Za-z]' THEN {c} "
            f"WHEN {c} LIKE '$-%' THEN concat('-$', substring({c}, 3)) WHEN {c} LIKE '$%' OR {c} LIKE '-$%' THEN {c} "
            f"WHEN {c} LIKE '-%' THEN concat('-$', substring({c}, 2)) ELSE concat('$', {c}) END")


def percent_display(c: str) -> str:
    """Percent display with one decimal; bare values under 5 are read as fractions."""
    n = f"try_cast(regexp_extract({c}, {rx(r'\d+\.?\d*')}, 0) AS decimal(18,4))"
    one = f"concat(cast(cast(if(NOT contains({c}, '%') AND {n} > 0 AND {n} < 5, {n} * 100, {n}) AS decimal(18,1)) AS string), '%')"
    return (f"CASE WHEN coalesce({c}, '') = '' THEN '-' WHEN {c} IN ('0', '0%') THEN '0.0%' "
            f"WHEN {n} IS NULL THEN if(endswith({c}, '%'), {c}, concat({c}, '%')) ELSE {one} END")


def value_display(c: str) -> str:
    return f"if(coalesce({c}, '') = '', '-', {c})"


def humanised(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(coalesce({c}, '')), '_+', ' '), {rx('\\s+')}, ' '))"


def not_reported(c: str) -> str:
    return f"coalesce(lower(trim({c})) = 'not reported', false)"
