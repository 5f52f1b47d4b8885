"""Expressions for locating printed evidence: value spellings, labels, facts and boxes."""

from __future__ import annotations

from tradeglass import vocab
from tradeglass.functions.money import PATTERN as MONEY
from tradeglass.functions.text import lit, lookup, match_text, norm_text, one_of, rx


def simple(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '')"


def value_candidates(c: str) -> str:
    """Spellings of a value to look for on a page; short ones are left out."""
    text = match_text(c)
    plain = f"if(contains({c}, '$'), {match_text(f"replace(replace({c}, '$', ''), ',', '')")}, '')"
    month = match_text(f"replace({c}, ',', '')")
    return f"array_distinct(filter(array({text}, {simple(c)}, {plain}, {month}), x -> length(x) >= 4))"


def label_to_history_field(label: str) -> str:
    """History field a comparison label speaks about: its own name, else the first keyword it holds."""
    text, compact = match_text(label), simple(label)
    direct = lookup(compact, {f.lower(): f for f in vocab.HISTORY_FIELDS})
    cases = " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in vocab.COMPARISON_KEYWORDS.items())
    return f"coalesce({direct}, CASE {cases} END)"


def printed_label(label: str) -> str:
    """Printed label of a scalar citation; '' when it is known to have none, null when unmapped."""
    text, compact = match_text(label), simple(label)
    cases = " ".join(f"WHEN contains({text}, '{k}') THEN {lit(vocab.PRINTED_LABELS[v])}"
                     for k, v in vocab.CITATION_KEYWORDS.items())
    return f"coalesce({lookup(compact, vocab.PRINTED_LABELS)}, CASE {cases} END)"


def low_signal(c: str) -> str:
    return f"({one_of(match_text(c), vocab.LOW_SIGNAL_TOKENS)} OR length({simple(norm_text(c))}) < 3)"


def fact_values(fact: str) -> str:
    """(label, value) candidates of a supporting fact: the labelled value, dates, amounts, masked numbers."""
    text = norm_text(fact)
    pair = (f"if(contains({text}, ':'), array(named_struct('label', trim(substring_index({text}, ':', 1)), "
            f"'value', trim(substring({text}, instr({text}, ':') + 1)))), array())")

    def found(label: str, pattern: str, group: int, keep: str = "true") -> str:
        hits = f"filter(regexp_extract_all({text}, {pattern}, {group}), x -> {keep})"
        return f"transform({hits}, x -> named_struct('label', '{label}', 'value', {norm_text('x')}))"

    digits = "regexp_replace(x, '[^0-9]', '')"
    not_year = f"NOT (length({digits}) = 4 AND {digits} BETWEEN '1900' AND '2099')"
    return (f"concat({pair}, {found('Date', rx(vocab.FACT_DATE_PATTERN), 0)}, {found('Amount', MONEY, 0, not_year)}, "
            f"{found('Account number', rx(vocab.MASKED_NUMBER_PATTERN), 1)})")


# --- boxes: structs of x, y, width, height ----------------------------------------


def box_union(a: str, b: str) -> str:
    x, y = f"least({a}.x, {b}.x)", f"least({a}.y, {b}.y)"
    return (f"named_struct('x', {x}, 'y', {y}, 'width', greatest({a}.x + {a}.width, {b}.x + {b}.width) - {x}, "
            f"'height', greatest({a}.y + {a}.height, {b}.y + {b}.height) - {y})")


def box_clip(a: str, page_width: str, page_height: str) -> str:
    x = f"greatest(0.0, least({page_width}, {a}.x))"
    y = f"greatest(0.0, least({page_height}, {a}.y))"
    return (f"named_struct('x', cast(round({x}) AS int), 'y', cast(round({y}) AS int), "
            f"'width', cast(round(greatest(1.0, least(greatest(0.0, {page_width} - {x}), {a}.width))) AS int), "
            f"'height', cast(round(greatest(1.0, least(greatest(0.0, {page_height} - {y}), {a}.height))) AS int))")


def box_scale(a: str, sx: str, sy: str) -> str:
    return (f"named_struct('x', {a}.x * {sx}, 'y', {a}.y * {sy}, 'width', greatest(1.0, {a}.width * {sx}), "
            f"'height', greatest(1.0, {a}.height * {sy}))")


def boxes_close(a: str, b: str, dx: str, dy: str) -> str:
    """True when the boxes overlap once each is grown by the margins."""
    return (f"NOT ({a}.x + {a}.width + {dx} < {b}.x OR {b}.x + {b}.width + {dx} < {a}.x "
            f"OR {a}.y + {a}.height + {dy} < {b}.y OR {b}.y + {b}.height + {dy} < {a}.y)")
