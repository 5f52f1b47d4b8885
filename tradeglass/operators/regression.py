"""Expected against actual tables by a tree of digests: table, report, entity, cell.

A side is rows (shape, report_id, entity_key, cell, value): counts, pages, fields and month cells alike. A row's
digest is a hash of all five; a branch's digest is the sum and the xor of its rows' digests and their number,
which are fixed-width, order-free and combine before the shuffle. Only branches whose digests differ are opened:
reports first, then the entities of those, then the cells of those, so equal data is hashed once and never joined cell
by cell, and a difference anywhere is found. A row that one side has more than once is a difference too.

Odd inputs: null values are equal to each other and to nothing else; null keys are keys; a shape or a report
that one side lacks is all missing or all unexpected; two empty sides agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeglass.session import stored

LEVELS = (["shape", "report_id"], ["shape", "report_id", "entity_key"], ["shape", "report_id", "entity_key", "cell"])


def _digest(rows: DataFrame, key: list[str], side: str) -> DataFrame:
    """Digest of every branch of a key; sums wrap around, so they are taken of halves."""
    low, high = F.expr("h & 4294967295"), F.expr("shiftrightunsigned(h, 32)")
    return rows.groupBy(*key).agg(F.struct(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.bit_xor("h").alias("x")).alias(side))


def _same(left: str, right: str, keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return test


def _open(rows: DataFrame, branches: DataFrame, key: list[str]) -> DataFrame:
    return rows.alias("r").join(branches.select(*key).alias("b"), _same("r", "b", key), "left_semi")


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """shape, report_id, entity_key, cell, expected, actual, kind (missing, unexpected, changed or repeated) of every cell that differs.

    A cell with several rows on a side shows its least value.
    """
    names = LEVELS[-1]
    sides = {}
    for side, rows in (("expected", expected), ("actual", actual)):
        plain = rows.select(*(F.col(c).cast("string").alias(c) for c in [*names, "value"]))
        sides[side] = stored(plain.withColumn("h", F.xxhash64(*names, "value", F.col("value").isNull())), f"{side}-rows")
    for key in LEVELS:
        e, a = (_digest(sides[s], key, s) for s in ("expected", "actual"))
        both = e.alias("e").join(a.alias("a"), _same("e", "a", key), "full")
        differ = stored(both.where(~F.col("expected").eqNullSafe(F.col("actual"))).select(*(F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in key)), "differing")
        sides = {s: _open(rows, differ, key) for s, rows in sides.items()}
    values = [sides[s].groupBy(*names).agg(F.min("value").alias(s), F.count("*").alias(f"n_{s}")) for s in ("expected", "actual")]
    both = values[0].alias("e").join(values[1].alias("a"), _same("e", "a", names), "full")
    kind = (F.when(F.col("n_expected").isNull(), "unexpected").when(F.col("n_actual").isNull(), "missing")
            .when(F.col("expected").eqNullSafe(F.col("actual")) & (F.col("n_expected") != F.col("n_actual")), "repeated").otherwise("changed"))
    return both.select(*(F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in names), "expected", "actual", kind.alias("kind"))


def summary(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per shape: number of differing cells by kind; shapes without any are absent."""
    return differences(expected, actual).groupBy("shape", "kind").agg(F.count("*").alias("n_cells"))
