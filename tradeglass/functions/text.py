"""Text normalisation as Spark SQL expressions.

Every function takes and returns expression text for selectExpr / F.expr, so a wide
plan is parsed once by Spark. Raw text is never overwritten; results are new columns.
Functions named on "normalised" text expect norm_text output.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tradeglass import vocab


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rx(pattern: str) -> str:
    """A regular expression literal (raw, so patterns read as written)."""
    return f"r'{pattern}'"


def one_of(c: str, values: list[str]) -> str:
    return f"({c} IN ({', '.join(lit(v) for v in values)}))"


def lookup(c: str, table: dict) -> str:
    """Value of a fixed table, null for other keys."""
    pairs = ", ".join(f"{lit(str(k))}, {lit(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"element_at(map({pairs}), {c})"


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add named expressions in one projection."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def add_needed(df: DataFrame, layers: list[dict[str, str]], wanted: set[str] | None) -> DataFrame:
    """Add layers of named expressions, leaving out those no wanted name depends on."""
    for layer in needed(layers, wanted):
        if layer:
            df = add(df, layer)
    return df


def needed(layers: list[dict[str, str]], wanted: set[str] | None) -> list[dict[str, str]]:
    """The part of each layer that the wanted names depend on, directly or through later layers."""
    if wanted is None:
        return layers
    names, kept = set(wanted), []
    for layer in reversed(layers):
        part = {k: v for k, v in layer.items() if k in names}
        names |= names_in(part.values())
        kept.append(part)
    return kept[::-1]


def names_in(expressions) -> set[str]:
    return {word for sql in expressions for word in re.findall(r"\w+", sql)}


def either(patterns: list[str]) -> str:
    """One regular expression for any of several."""
    return "|".join(patterns)


def norm_text(c: str) -> str:
    """Whitespace runs (including no-break space) become one space; null becomes ''."""
    return f"trim(regexp_replace(coalesce({c}, ''), {rx('(?U)\\s+')}, ' '))"


def match_text(c: str) -> str:
    return f"lower({norm_text(c)})"


def identity_key(c: str) -> str:
    text = match_text(c)
    for word, short in (("junior", "jr"), ("senior", "sr"), ("saint", "st")):
        text = f"regexp_replace({text}, {rx(rf'\b{word}\b')}, '{short}')"
    return f"regexp_replace({text}, '[^a-z0-9]', '')"


def is_missing(c: str) -> str:
    return one_of(match_text(c), vocab.MISSING_TOKENS)


def missing(c: str) -> str:
    """is_missing for normalised text; null counts as missing."""
    return one_of(f"lower(coalesce({c}, ''))", vocab.MISSING_TOKENS)


def contains_any(c: str, words: list[str]) -> str:
    """True when any word occurs in text that is already in match form."""
    return f"({c} RLIKE {rx('|'.join(re.escape(w) for w in words))})"


def joined(*cols: str) -> str:
    return match_text(f"concat_ws(' ', {', '.join(cols)})")


def cell_state(c: str) -> str:
    text = f"trim(TRAILING ':' FROM {match_text(c)})"
    return (f"CASE WHEN {norm_text(c)} = '' THEN 'blank' WHEN {one_of(text, vocab.EXPLICIT_NOT_REPORTED)} "
            f"THEN 'explicit_not_reported' ELSE 'value' END")


def first_text(*cols: str) -> str:
    """First normalised text that is not empty, else ''."""
    return f"coalesce({', '.join(f"nullif({norm_text(c)}, '')" for c in cols)}, '')"


def first_meaningful(*cols: str) -> str:
    """First normalised text that is not one of the missing tokens, else null."""
    return f"coalesce({', '.join(f'if({is_missing(c)}, NULL, {norm_text(c)})' for c in cols)})"


def split_lines(c: str) -> str:
    parts = f"transform(split(coalesce({c}, ''), {rx('[\\n;|]')}), x -> {norm_text('x')})"
    return f"filter({parts}, x -> x <> '')"


def unique_ci(arr: str) -> str:
    """Case-insensitive distinct of a short list, keeping the first spelling and the order."""
    return f"filter({arr}, (x, i) -> array_position(transform({arr}, y -> lower(y)), lower(x)) = i + 1)"


def phones(c: str) -> str:
    return f"transform(regexp_extract_all({c}, {rx(vocab.PHONE_PATTERN)}, 0), x -> {norm_text('x')})"


def strip_phones(c: str) -> str:
    text = f"regexp_replace(coalesce({c}, ''), {rx(vocab.PHONE_PATTERN)}, ' ')"
    return norm_text(f"regexp_replace(regexp_replace({text}, {rx('\\s*\\|\\s*')}, ' '), {rx('\\s+,')}, ',')")


def institution_key(c: str) -> str:
    words = "|".join(vocab.CORPORATE_SUFFIXES)
    return f"regexp_replace(regexp_replace({match_text(c)}, {rx(rf'\b(?:{words})\b')}, ''), '[^a-z0-9]', '')"


def page_list(arr: str) -> str:
    return f"array_distinct(filter({arr}, p -> p > 0))"


def canonical_subscriber(c: str) -> str:
    words = "|".join(vocab.PURPOSE_PHRASES)
    text = f"regexp_replace({match_text(c)}, {rx(rf'\b(?:{words})\b.*$')}, '')"
    return f"trim(regexp_replace({text}, {rx('[\\s,.;:]+$')}, ''))"


def clean_account_number(c: str) -> str:
    text = f"trim(regexp_replace(replace(coalesce({c}, ''), ' ', ' '), {rx('[\\r\\n\\t]+')}, ' '))"
    text = f"regexp_replace({text}, {rx('(?i)\\b(?:reported\\s+balance|available\\s+credit)\\b.*$')}, '')"
    text = f"regexp_replace({text}, {rx('^[ :;,.]+|[ :;,.]+$')}, '')"
    return f"if({text} = '', 'Not reported', {text})"


def account_number_key(c: str) -> str:
    text = match_text(f"regexp_replace(coalesce({c}, ''), {rx('[^A-Za-z0-9*\\-\\s]')}, '')")
    return f"if({text} = '', 'not reported', {text})"


def number_tail(c: str, n: int = 4) -> str:
    return f"right(regexp_replace({norm_text(c)}, '[^0-9]', ''), {n})"


def solid_tail(c: str) -> str:
    """Last six (else four) characters of a number without its mask characters."""
    whole = f"regexp_replace({match_text(c)}, '[^a-z0-9]', '')"
    token = f"coalesce(nullif(replace({whole}, 'x', ''), ''), {whole})"
    return f"CASE WHEN length({token}) >= 6 THEN right({token}, 6) WHEN length({token}) >= 4 THEN right({token}, 4) ELSE {token} END"


def incomplete_number(c: str) -> str:
    text = norm_text(c)
    return (f"({missing(text)} OR {text} RLIKE '(?i)[*#x]' "
            f"OR length(regexp_replace({text}, '(?i)[^a-z0-9]', '')) < 6)")


def field_provenance_id(name: str, number: str, field: str) -> str:
    return (f"concat('account:', {match_text(name)}, '::', {clean_account_number(number)}, ':field:', "
            f"{norm_text(field)})")


def month_provenance_id(name: str, number: str, field: str, year: str, month: str) -> str:
    return (f"concat('account:', {match_text(name)}, '::', {clean_account_number(number)}, ':history:', "
            f"{norm_text(field)}, ':', {norm_text(year)}, ':', {match_text(month)})")


def exhibit_label(position: str, style: str = "number") -> str:
    """1, 2, 3 ... or A ... Z, AA, AB ... for a 1-based position of any size."""
    if style == "number":
        return f"cast({position} AS string)"
    # 14 letters name every bigint
    return (f"aggregate(sequence(1, 14), struct(cast({position} AS bigint) AS n, '' AS s), "
            "(a, i) -> if(a.n > 0, struct((a.n - 1) div 26 AS n, concat(chr(65 + (a.n - 1) % 26), a.s) AS s), a), a -> a.s)")


def stable_choice(seed: str, key: str, n: int) -> str:
    """A repeatable pick in [0, n) from the first eight hex digits of sha1(seed:key)."""
    head = f"substring(sha1(concat({seed}, ':', {key})), 1, 8)"
    return f"cast(cast(conv({head}, 16, 10) AS bigint) % {n} AS int)"


def preferred_name(a: str, b: str) -> str:
    """b when it covers every word of a and is no shorter, else the longer; empty loses."""
    na, nb = norm_text(a), norm_text(b)
    covered = f"size(array_except(split(lower({na}), ' '), split(lower({nb}), ' '))) = 0"
    return (f"CASE WHEN {na} = '' THEN {nb} WHEN {nb} = '' THEN {na} "
            f"WHEN {covered} AND length({nb}) >= length({na}) THEN {nb} "
            f"WHEN length({na}) >= length({nb}) THEN {na} ELSE {nb} END")


def address_parts(c: str) -> str:
    """Split 'line, city, ST 12345' into its parts; any other shape stays whole in line."""
    whole = f"trim(coalesce({c}, ''))"
    parts = f"filter(transform(split({whole}, ','), x -> trim(x)), x -> x <> '')"
    tail = f"coalesce(get({parts}, 2), '')"
    shape = rx(r"(?i)^([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$")
    return (f"named_struct('line', if({tail} RLIKE {shape}, get({parts}, 0), {whole}), "
            f"'city', if({tail} RLIKE {shape}, get({parts}, 1), ''), "
            f"'state', upper(regexp_extract({tail}, {shape}, 1)), 'zip', regexp_extract({tail}, {shape}, 2))")


def fill_missing(base: str, fallback: str) -> str:
    """Null-filling merge of two scalar leaves: the base wins unless it is null or empty."""
    return f"coalesce(nullif({base}, ''), {fallback})"
