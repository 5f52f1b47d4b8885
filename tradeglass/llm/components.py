"""Connected components of a link table, and buckets split into bounded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeglass.session import stored


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge, label being the smallest node it reaches.

    Every round takes the smallest label among a node's neighbours and then follows the label of that
    label, so chains shrink by doubling. Rounds end when nothing changes. Rounds are written to the
    shared folder. No rows give no rows; loops and repeated edges change nothing.
    """
    a, b = F.col(u).alias("node"), F.col(v).alias("other")
    both = stored(edges.select(a, b).union(edges.select(F.col(v), F.col(u))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        best = both.join(theirs, "other").groupBy("node").agg(F.min("near").alias("near"))
        near = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = stored(near.join(jump, "near").select("node", "old", F.least("near", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def cells(members: DataFrame, keys: list[str], node: str, block: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Members of buckets of two or more, dealt to cells of at most about two blocks.

    A bucket of n members has ceil(n / block) blocks (or more, so that a block weighs about `most`), and a cell for
    each pair of blocks, so each pair of members meets in one cell. Adds cell (a digest of bucket and
    pair), mine (the member's block), and low and high (the cell's blocks; equal in a cell of one block).
    Nothing is dropped.
    """
    heavy = F.sum(weight) / most if weight else F.lit(0.0)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("bucket_size"), heavy.alias("bucket_weight")).where("bucket_size > 1")
    blocks: Column = F.least(F.col("bucket_size"), F.ceil(F.greatest(F.col("bucket_size") / block, F.col("bucket_weight")))).cast("int")
    dealt = members.join(sizes, keys).withColumn("mine", F.pmod(F.xxhash64(node), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (dealt.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
            .withColumn("cell", F.xxhash64(*keys, "low", "high")).drop("other", "bucket_size", "bucket_weight"))
