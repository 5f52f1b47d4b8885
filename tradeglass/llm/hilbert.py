"""Sharding along a Hilbert curve over several metadata columns, with DataFrame functions only.

Every metadata column is cut at its quantiles into 2^BITS steps; strings are placed by the rank of their
value among the distinct values, in byte order over the whole string, so steps follow string order. The cell's position on the Hilbert curve is the sort key,
then the text's checksum, size and id, so equal texts with equal metadata stand side by side. Runs of
the order become shards: neighbours on the curve share ranges of every dimension, which is what
file statistics prune by.

Law `rows`: shard = rank * shards div rows, so counts differ by one at most.

Odd inputs: nulls in a metadata column take step 0; a null text has size 1 and checksum 0, as has an
empty one; null and repeated ids are placed like any others (equal rows may swap places); an empty
table has no shards. Columns of the input are read by name and none is added to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tradeglass.session import stored

BITS, SHARDS = 5, 8


def numbered(rows: DataFrame, dims: list[str]) -> DataFrame:
    """rows with every dimension as a number in the order of its values: strings by their rank among the distinct values."""
    for d in dims:
        if isinstance(rows.schema[d].dataType, T.StringType):
            values = ranked(rows.where(F.col(d).isNotNull()).select(F.encode(d, "UTF-8").alias("_value")).distinct(), ["_value"])
            # written first, so that the size of a short table of values is known before rows are joined with it
            values = stored(values.select("_value", F.col("rank").cast("double").alias("_rank")), "values")
            rows = rows.join(values, F.encode(d, "UTF-8") == F.col("_value"), "left").withColumn(d, F.col("_rank")).drop("_value", "_rank")
        else:
            rows = rows.withColumn(d, F.col(d).cast("double"))
    return rows


def quantised(docs: DataFrame, dims: dict[str, Column], bits: int = BITS) -> dict[str, Column]:
    """Step (0 to 2^bits - 1) of every dimension, from quantiles over all rows."""
    steps = 1 << bits
    marks = [i / steps for i in range(1, steps)]
    cuts = docs.agg(*[F.percentile_approx(c, marks, 10_000).alias(n) for n, c in dims.items()]).first()
    found = {}
    for name, column in dims.items():
        edges = sorted({x for x in cuts[name] or [] if x is not None})
        above = [F.when(column > F.lit(x), 1).otherwise(0) for x in edges]
        found[name] = reduce(lambda a, b: a + b, above, F.lit(0)).cast("long")
    return found


def curve_index(steps: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell, by Skilling's transpose form.

    From the highest bit down, each axis either inverts the lower bits of the first axis or swaps them
    with its own; a Gray code over the axes and an interleaving of their bits finish the index.
    """
    n = len(steps)
    todo = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(n)]
    moves = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(a).alias("a")) for q, a in todo])

    def move(x: Column, m: Column) -> Column:
        low = m["q"] - F.lit(1).cast("long")
        own, first = F.get(x, m["a"]), F.get(x, F.lit(0))
        is_set = own.bitwiseAND(m["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, i: F.when(is_set, F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))
                           .otherwise(F.when(m["a"] == 0, v).when((i == 0) | (i == m["a"]), v.bitwiseXOR(swap)).otherwise(v)))

    placed = F.aggregate(moves, F.array(*steps), move) if todo else F.array(*steps)

    def gray(x: Column) -> Column:
        def running(acc: Column, v: Column) -> Column:
            return F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")).bitwiseXOR(v)))
        return F.aggregate(x, F.array().cast("array<long>"), running)

    def folded(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        turn = reduce(lambda a, b: a.bitwiseXOR(b),
                      [F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(0).cast("long") for b in range(bits - 1, 0, -1)],
                      F.lit(0).cast("long"))
        return F.transform(x, lambda v: v.bitwiseXOR(turn))

    def interleaved(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in range(bits - 1, -1, -1) for a in range(n)])
        return F.aggregate(order, F.lit(0).cast("long"), lambda d, o: d * 2 + F.call_function("shiftright", F.get(x, o["a"]), o["b"]).bitwiseAND(F.lit(1).cast("long")))

    # one array travels through the stages inside aggregate(), so no expression is written out twice
    def staged(x: Column, stage) -> Column:
        return F.get(F.transform(F.array(x), stage), F.lit(0))

    return staged(staged(staged(placed, gray), folded), interleaved)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with rank (0-based place in the order of keys, nulls first) and total.

    Ranges of the keys are sorted apart and written down once; a row's rank is its place in its range
    plus the rows of the ranges before it. The table of ranges has one short row per partition.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    laid = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    parts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    begins = parts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_begin"),
                          F.sum("_rows").over(Window.partitionBy()).alias("total"))
    return (laid.withColumn("_part", part).join(F.broadcast(begins), "_part")
            .withColumn("rank", F.col("_begin") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_place", "_begin"))


def _placed(docs: DataFrame, dims: list[str], doc_id: str, text: str, carried: list[Column]) -> DataFrame:
    """Rows with size, text_crc32, curve, shard (0 to SHARDS - 1 of `shards`), rank and total, and what is carried along."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
                         F.crc32(whole).alias("text_crc32"),
                         *[F.col(d).alias(f"_dim{i}") for i, d in enumerate(dims)], *carried)
    narrow = numbered(narrow, [f"_dim{i}" for i in range(len(dims))])
    axes = {f"_dim{i}": F.col(f"_dim{i}") for i in range(len(dims))} | {"size": F.col("size").cast("double")}
    steps = quantised(narrow, axes)
    placed = narrow.withColumns({f"_step{i}": s for i, s in enumerate(steps.values())})
    curve = placed.select("doc_id", "size", "text_crc32", curve_index([F.col(f"_step{i}") for i in range(len(steps))]).alias("curve"),
                          *(["_row"] if carried else []))
    return ranked(curve, ["curve", "text_crc32", "size", "doc_id"])


def assign(docs: DataFrame, dims: list[str], doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, curve, law, shard, slot, grown_shard of every row."""
    rows = _placed(docs, dims, doc_id, text, [])
    return rows.withColumn("shard", F.expr(f"(rank * {shards}) div total")).select(
        "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, dims: list[str], path: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write all rows of docs in curve order, one folder _shard=k per shard, so that file statistics cover short ranges.

    The rows travel whole through the ranking, so rows without doc_id, or that repeat one, are written too,
    and every column keeps its name.
    """
    rows = _placed(docs, dims, doc_id, text, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")])
    laid = rows.select("_row", "rank", F.expr(f"cast((rank * {shards}) div total AS int)").alias("_shard"))
    laid = laid.repartitionByRange("_shard", "rank").sortWithinPartitions("_shard", "rank")
    laid.select("_row.*", F.col("_shard").alias(_free("_shard", docs.columns))).write.partitionBy(_free("_shard", docs.columns)).parquet(path)


def _free(name: str, taken: list[str]) -> str:
    """The name, with as many further underscores as it takes not to be taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
