"""Building blocks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass.session import stored


def grouped_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """row_number within group by a unique ascending order, without gathering a group in one task.

    The rows are written first, so they are computed once, although the range bounds are sampled from them before
    they are dealt. Rows are range-partitioned on (group, order), so a large group spans many
    partitions; each writes its rows in order with their place in it. Counts per (group,
    partition) give each partition's offset, which is all that a row's place lacks. The offset
    table has at most one row per group and partition boundary.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df, "unranked").repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ranged")
    counts = fixed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).where("_offset <> 1")
    o = offsets.select(*(F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]), "_offset")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_part"]))
    rank = (F.col("_place") + F.coalesce("_offset", F.lit(1))).cast("long")
    return fixed.join(o, same, "left").select(*group, *(c for c in df.columns if c not in group), rank.alias(name))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, how: str = "left",
                salts: int = 16) -> DataFrame:
    """Equi join of a side where one key may own a large share of rows with a side of one row per key.

    Rows of the big side are spread over salts by a hash of another column; the small
    side is repeated once per salt, so a hot key is joined in as many tasks.
    """
    left = big.withColumn("_salt", F.expr(f"cast(pmod(xxhash64({spread_by}), {salts}) AS int)"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def contains_join(needles: DataFrame, haystacks: DataFrame, keys: list[str], needle: str, hay: str,
                  q: int = 4) -> DataFrame:
    """Distinct (keys, needle, hay) where hay contains needle, exactly and without pairing a whole group.

    A needle looks only at haystacks that hold its rarest q-gram of the same keys;
    needles shorter than q are joined on themselves. Gram rows carry a digest instead of
    the text, so emission grows with the length of the texts, never with
    needles x haystacks, and the texts themselves meet only for surviving candidates.
    """
    n = needles.select(*keys, needle).where(F.length(needle) > 0).distinct().withColumn("_n", F.sha2(needle, 256))
    h = haystacks.select(*keys, hay).where(F.length(hay) > 0).distinct().withColumn("_h", F.sha2(hay, 256))

    def grams(text: str, size: int) -> str:
        """Overlapping substrings of one length, read in a single pass over the text."""
        return f"array_distinct(regexp_extract_all({text}, r'(?s)(?=(.{{{size}}}))', 1))"

    hay_grams = h.selectExpr(*keys, "_h", f"explode({grams(hay, q)}) AS gram")
    frequency = hay_grams.groupBy(*keys, "gram").agg(F.count("*").alias("freq"))
    rarest = (
        n.where(F.length(needle) >= q).selectExpr(*keys, "_n", f"explode({grams(needle, q)}) AS gram")
        .join(frequency, [*keys, "gram"], "left")
        .groupBy(*keys, "_n").agg(F.expr("min_by(gram, struct(coalesce(freq, 0), gram)) AS gram"))
    )
    short_grams = ", ".join(grams(hay, i) for i in range(1, q))
    short_hay = h.selectExpr(*keys, "_h", f"explode(flatten(array({short_grams}))) AS {needle}")
    short = n.where(F.length(needle) < q).join(short_hay, [*keys, needle]).select(*keys, "_n", "_h")
    candidates = rarest.join(hay_grams, [*keys, "gram"]).select(*keys, "_n", "_h").unionByName(short)
    texts = candidates.join(n, [*keys, "_n"]).join(h, [*keys, "_h"])
    return texts.where(F.contains(F.col(hay), F.col(needle))).select(*keys, needle, hay)
