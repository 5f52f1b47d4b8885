"""Monthly history as bits: one row per account and word of months, one bigint per property of a month.

Cells are reduced to small integers first, so both aggregates (one cell per month, one word per five years)
run on fixed-width buffers by hash and combine before the shuffle; what is shuffled by account is a
few words, not a row per month with texts. A word is aligned to years, so the printed years of a word
are masks, and what a month needs from earlier words (last meaningful cell, cells so far, highest rank)
is a window over an account's words. Inside a word neighbours, gaps, resets and runs are shifts, masks and bit
counts; only the months that a rule may name become rows. Texts and amounts are read for those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions import codes
from tradeglass.functions.money import amount
from tradeglass.functions.text import add, lookup, missing
from tradeglass.operators.history import ACCOUNT, KEY, provable_slots

MONTHS_A_WORD = 60
#: Bits of a cell: meaningful, current, derogatory, four of its severity rank, three that tell codes of one rank apart.
RANK_AT, KIND_AT = 3, 7
SAME_RANK = {rank: [c for c in vocab.DEROGATORY_CODES if vocab.SEVERITY_RANK[c] == rank] for rank in sorted(set(vocab.SEVERITY_RANK.values()))}
PLANES = {"seen": 0, "cur": 1, "der": 2, **{f"r{j}": RANK_AT + j for j in range(4)}, **{f"v{j}": KIND_AT + j for j in range(3)}}


def cell_bits(code: str) -> str:
    """The bits of a conformed status code, as an int; 0 for blank ones."""
    known = {c: 5 + (rank << RANK_AT) + (i << KIND_AT) for rank, same in SAME_RANK.items() for i, c in enumerate(same)}
    known |= {c: 3 for c in vocab.CURRENT_CODES} | {c: 0 for c in vocab.BLANK_CODES}
    return f"coalesce({lookup(code, known)}, 1)"


def month_words(cells: DataFrame) -> DataFrame:
    """KEY, word and a bigint per property: status printed, the cell's bits, provable gap slot, payment activity.

    The last duplicate of a month wins. cell covers every month of each year that prints a status.
    """
    of = "if(series = '{0}', {1}, NULL)"
    known = f"CASE series WHEN 'status' THEN {cell_bits(codes.conformed_code('value_text'))} WHEN 'last_payment_date' THEN cast(NOT {missing('value_text')} AS int) ELSE cast(coalesce({amount('value_text')} > 0, false) AS int) END"
    small = provable_slots(cells).where("series IN ('status', 'paid', 'scheduled', 'last_payment_date', 'gap_slot')").selectExpr(*KEY, "series", "m", "ord", f"{known} AS v")
    last = [F.expr(f"max_by({of.format(s, 'v')}, {of.format(s, 'ord')}) AS {s}") for s in ("status", "paid", "scheduled", "last_payment_date")]
    months = small.groupBy(*KEY, "m").agg(*last, F.expr("max(series = 'gap_slot') AS slot"))
    bit = f"shiftleft(1L, cast(pmod(m, {MONTHS_A_WORD}) AS int))"

    def plane(name: str, test: str) -> F.Column:
        return F.expr(f"bit_or(if({test}, {bit}, 0L)) AS {name}")

    own = [plane(name, f"coalesce(status, 0) & {1 << at} <> 0") for name, at in PLANES.items()]
    words = months.groupBy(*KEY, F.expr(f"cast(floor(m / {MONTHS_A_WORD}) AS int)").alias("word")).agg(
        plane("printed", "status IS NOT NULL"), *own, plane("slot", "slot"), plane("active", "coalesce(paid, 0) + coalesce(scheduled, 0) + coalesce(last_payment_date, 0) > 0"))
    years = " | ".join(f"if(printed & {4095 << 12 * y}L = 0L, 0L, {4095 << 12 * y}L)" for y in range(MONTHS_A_WORD // 12))
    return add(add(words, {"cell": years}), {"blank": "cell & ~seen"})


def highest(x: str) -> str:
    """Place of the highest bit; -1 for none."""
    return f"if({x} = 0L, -1, length(bin({x})) - 1)"


def lowest(x: str) -> str:
    """Place of the lowest bit; -1 for none."""
    return f"if({x} = 0L, -1, length(bin({x} & -({x}))) - 1)"


def below(i: str) -> str:
    return f"(shiftleft(1L, cast({i} AS int)) - 1L)"


def bit_at(plane: str, i: str) -> str:
    return f"(shiftright({plane}, cast({i} AS int)) & 1L)"


def rank_at(i: str) -> str:
    return f"cast({' + '.join(f'{bit_at(f"r{j}", i)} * {1 << j}' for j in range(4))} AS int)"


def top_rank(x: str) -> dict[str, str]:
    """Layers t3..t0 that narrow a mask to its months of the highest rank; top is that rank."""
    layers, mask = {}, x
    for j in (3, 2, 1, 0):
        layers[f"t{j}"] = f"if({mask} & r{j} <> 0L, {mask} & r{j}, {mask})"
        mask = f"t{j}"
    return layers


def each_bit(mask: str) -> str:
    return f"explode(filter(sequence(0, {MONTHS_A_WORD - 1}), i -> {bit_at(mask, 'i')} = 1L)) AS i"


def _with_top(df: DataFrame, mask: str, name: str) -> DataFrame:
    for layer, sql in top_rank(mask).items():
        df = add(df, {layer: sql})
    return add(df, {name: f"if({mask} = 0L, 0, {rank_at('greatest(0, ' + highest('t0') + ')')})"}).drop("t3", "t2", "t1", "t0")


def with_carry(words: DataFrame) -> DataFrame:
    """Words with what the account's earlier words leave: last meaningful, derogatory and current month, counts, top rank."""
    d = add(words, {f"{p}_i": highest(p) for p in ("seen", "der", "cur")} | {"provable": "blank & slot", "n_cell": "bit_count(cell)", "n_provable": "bit_count(blank & slot)"})
    d = _with_top(d, "der", "own_top")
    w = f"(PARTITION BY {ACCOUNT} ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    d = add(d, {"cells_before": f"coalesce(sum(n_cell) OVER {w}, 0L)", "provable_before": f"coalesce(sum(n_provable) OVER {w}, 0L)", "top_before": f"coalesce(max(own_top) OVER {w}, 0)"})

    def at(p: str) -> str:
        return f"greatest(0, {p}_i)"

    last_seen = (f"struct(word * {MONTHS_A_WORD} + seen_i AS m, {rank_at(at('seen'))} AS rank, {bit_at('cur', at('seen'))} = 1L AS cur, {bit_at('active', at('seen'))} = 1L AS active, "
                 f"cells_before + bit_count(cell & (below_seen | shiftleft(1L, cast({at('seen')} AS int)))) AS cell_no, provable_before + bit_count(provable & below_seen) AS provable_no)")
    d = add(d, {"below_seen": below(at("seen"))})
    d = add(d, {"own_seen": f"if(seen = 0L, NULL, {last_seen})", "own_der": f"if(der = 0L, NULL, struct(word * {MONTHS_A_WORD} + der_i AS m, {rank_at(at('der'))} AS rank))",
                "own_cur": f"if(cur = 0L, NULL, struct(word * {MONTHS_A_WORD} + cur_i AS m, {bit_at('active', at('cur'))} = 1L AS active))"})
    return add(d, {f"{p}_before": f"last(own_{p}, true) OVER {w}" for p in ("seen", "der", "cur")})


#: Row tests of the derogatory months; the account's opening month and layout decide the last ones.
KINDS = {
    "regression": "der_m IS NOT NULL AND (cur_m IS NULL OR cur_m < der_m) AND rank > 0 AND rank < der_rank",
    "severe_jump": "rank > 1 AND prev_m IS NOT NULL AND (prev_cur OR (prev_rank > 0 AND rank > prev_rank + 1))",
    "reaging": "rank > 1 AND cur_m > der_m",
    "first_30": "rank = 1 AND prev_m IS NULL AND m - opened_m >= 1",
    "first_severe": "rank > 1 AND prev_m IS NULL AND m - opened_m >= 1",
    "blank_gap": "prev_m IS NOT NULL AND gap_len BETWEEN 1 AND 2",
    "backfill": "rank > 1 AND prev_m IS NOT NULL AND gap_len >= 3 AND (coalesce(profile_id, '') <> 'experian_acr_v1' OR gap_provable >= gap_len)",
    "no_build_up": "rank IN (7, 8) AND (prev_m IS NULL OR prev_cur OR top < 4)",
}


def conflicts(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """KEY, kind, m, code, prev_m, gap_len, active, prev_active of every month that breaks a sequence rule.

    anchors: KEY, profile_id, opened_m of every account.
    """
    d = with_carry(words).where("der <> 0L").selectExpr("*", each_bit("der"))
    d = add(d, {"under": below("i"), "m": f"word * {MONTHS_A_WORD} + i", "rank": rank_at("i")})
    d = add(d, {f"{p}_p": highest(f"({p} & under)") for p in ("seen", "der", "cur")})
    d = _with_top(add(d, {"der_under": "der & under"}), "der_under", "word_top")

    def from_word(p: str, here: str, there: str) -> str:
        return f"if({p}_p >= 0, {here}, {p}_before.{there})"

    base = f"word * {MONTHS_A_WORD} + "
    d = add(d, {
        "prev_m": from_word("seen", base + "seen_p", "m"), "prev_rank": from_word("seen", rank_at("greatest(0, seen_p)"), "rank"),
        "prev_cur": f"coalesce({from_word('seen', bit_at('cur', 'greatest(0, seen_p)') + ' = 1L', 'cur')}, false)", "seen_active": from_word("seen", bit_at("active", "greatest(0, seen_p)") + " = 1L", "active"),
        "prev_no": from_word("seen", "cells_before + bit_count(cell & (shiftleft(1L, cast(greatest(0, seen_p) + 1 AS int)) - 1L))", "cell_no"),
        "prev_provable": from_word("seen", f"provable_before + bit_count(provable & {below('greatest(0, seen_p)')})", "provable_no"),
        "der_m": from_word("der", base + "der_p", "m"), "der_rank": from_word("der", rank_at("greatest(0, der_p)"), "rank"),
        "cur_m": from_word("cur", base + "cur_p", "m"), "cur_active": from_word("cur", bit_at("active", "greatest(0, cur_p)") + " = 1L", "active"),
        "top": "greatest(word_top, top_before)", "active_now": bit_at("active", "i") + " = 1L",
        "variant": f"cast({' + '.join(f'{bit_at(f"v{j}", "i")} * {1 << j}' for j in range(3))} AS int)",
    })
    d = add(d, {"gap_len": "cast(cells_before + bit_count(cell & under) - coalesce(prev_no, 0L) AS int)", "gap_provable": "provable_before + bit_count(provable & under) - coalesce(prev_provable, 0L)"})
    d = d.join(anchors.select(*KEY, "profile_id", "opened_m"), KEY, "left")
    measured = {"regression": ("der_m", "NULL"), "first_30": ("NULL", "NULL"), "first_severe": ("NULL", "NULL"), "reaging": ("cur_m", "cur_active")}
    kinds = ", ".join(
        f"if(coalesce({test}, false), named_struct('kind', '{kind}', 'prev_m', cast({measured.get(kind, ('prev_m', 'seen_active'))[0]} AS int), "
        f"'prev_active', cast({measured.get(kind, ('prev_m', 'seen_active'))[1]} AS boolean)), NULL)" for kind, test in KINDS.items())
    code = "CASE rank " + " ".join(f"WHEN {rank} THEN element_at(array({', '.join(repr(c) for c in same)}), variant + 1)" for rank, same in SAME_RANK.items()) + " END"
    return d.selectExpr(*KEY, "m", f"{code} AS code", "gap_len", "active_now AS active", f"explode(array_compact(array({kinds}))) AS k").selectExpr(
        *KEY, "k.kind AS kind", "m", "code", "k.prev_m AS prev_m", "gap_len", "active", "k.prev_active AS prev_active")


def balance_reduction_conflicts(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Conflicts other than regression over which the balance fell by 25 or more; balances of the named months only.

    A conflict's month and the month it is measured against are asked for together, so the balance cells are
    read once and joined by account and month.
    """
    named = found.where("kind <> 'regression' AND prev_m IS NOT NULL").selectExpr(*KEY, "kind", "m", "prev_m", "explode(array(struct(m AS at, 'now' AS side), struct(prev_m AS at, 'before' AS side))) AS ask")
    balance = cells.where("series = 'balance'").groupBy(*KEY, F.col("m").alias("at")).agg(F.expr(f"max_by({amount('value_text')}, ord) AS balance"))
    both = named.selectExpr(*KEY, "kind", "m", "prev_m", "ask.at AS at", "ask.side AS side").join(balance, [*KEY, "at"])
    sides = both.groupBy(*KEY, "kind", "m", "prev_m").agg(F.expr("max(if(side = 'now', balance, NULL)) AS balance"), F.expr("max(if(side = 'before', balance, NULL)) AS prev_balance"))
    return sides.where("prev_balance - balance >= 25")


def neighbours(words: DataFrame) -> DataFrame:
    """Nearest meaningful months before and after every blank cell."""
    before = f"(PARTITION BY {ACCOUNT} ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"(PARTITION BY {ACCOUNT} ORDER BY word ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    own = add(words, {"last_own": f"if(seen = 0L, NULL, word * {MONTHS_A_WORD} + {highest('seen')})", "first_own": f"if(seen = 0L, NULL, word * {MONTHS_A_WORD} + {lowest('seen')})"})
    d = add(own, {"last_before": f"max(last_own) OVER {before}", "first_after": f"min(first_own) OVER {after}"}).where("blank <> 0L").selectExpr("*", each_bit("blank"))
    d = add(d, {"under": f"seen & {below('i')}", "over": f"seen & ~{below('i')}"})
    base = f"word * {MONTHS_A_WORD} + "
    return d.selectExpr(*KEY, f"{base}i AS m", f"if(under = 0L, last_before, {base}{highest('under')}) AS older_m", f"if(over = 0L, first_after, {base}{lowest('over')}) AS newer_m")


def missing_months(words: DataFrame) -> DataFrame:
    """Blank cells strictly inside the meaningful range."""
    whole = f"(PARTITION BY {ACCOUNT})"
    own = add(words, {"last_own": f"if(seen = 0L, NULL, word * {MONTHS_A_WORD} + {highest('seen')})", "first_own": f"if(seen = 0L, NULL, word * {MONTHS_A_WORD} + {lowest('seen')})"})
    d = add(own, {"first_seen": f"min(first_own) OVER {whole}", "last_seen": f"max(last_own) OVER {whole}"}).where("blank <> 0L")
    return d.selectExpr(*KEY, "first_seen", "last_seen", f"word * {MONTHS_A_WORD} AS base", each_bit("blank")).selectExpr(*KEY, "base + i AS m", "first_seen", "last_seen").where(
        "m > first_seen AND m < last_seen").select(*KEY, "m")


def blank_runs(words: DataFrame) -> DataFrame:
    """Runs of consecutive blank cells: first and last month, length.

    A run starts where the month before is not blank and ends where the next is not; starts and ends of an
    account, in order, pair up, so no month inside a run becomes a row.
    """
    top = MONTHS_A_WORD - 1
    w = f"(PARTITION BY {ACCOUNT} ORDER BY word)"
    d = add(words, {"last_before": f"if(lag(word) OVER {w} = word - 1, coalesce({bit_at(f'lag(blank) OVER {w}', str(top))}, 0L), 0L)",
                    "first_after": f"if(lead(word) OVER {w} = word + 1, coalesce(lead(blank) OVER {w} & 1L, 0L), 0L)"}).where("blank <> 0L")
    full = f"{(1 << MONTHS_A_WORD) - 1}L"
    d = add(d, {"starts": f"blank & ~((shiftleft(blank, 1) | last_before) & {full})", "ends": f"blank & ~(shiftright(blank, 1) | shiftleft(first_after, {top}))"})
    d = add(d, {"firsts": f"transform(filter(sequence(0, {top}), i -> {bit_at('starts', 'i')} = 1L), i -> word * {MONTHS_A_WORD} + i)",
                "lasts": f"transform(filter(sequence(0, {top}), i -> {bit_at('ends', 'i')} = 1L), i -> word * {MONTHS_A_WORD} + i)"})
    edges = d.selectExpr(*KEY, "explode(concat(transform(firsts, m -> struct(m, false AS is_end)), transform(lasts, m -> struct(m, true AS is_end)))) AS e").selectExpr(*KEY, "e.m AS m", "e.is_end AS is_end")
    paired = add(edges, {"first_m": f"lag(m) OVER (PARTITION BY {ACCOUNT} ORDER BY m, is_end)"})
    return paired.where("is_end").selectExpr(*KEY, "first_m", "m AS last_m", "m - first_m + 1 AS n_months")
