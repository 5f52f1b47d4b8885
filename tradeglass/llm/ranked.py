"""Places of rows within ordered groups, where one group may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass.session import stored


def group_name(column: str):
    """A non-null string that names a group: nulls come first, then values bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with place (from 0, in their group by the order, nulls first) and size (rows of the group).

    Rows are range-partitioned by group and order, so a large group spans many partitions, and written
    once, so the numbering survives lost executors. Only one row per group and partition is windowed.
    The group must not be null, and rows that agree in all order columns must be interchangeable.
    """
    ordered = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
    fixed = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = fixed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    running = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
                                   F.sum("_n").over(whole).alias("size")), "offsets")
    return fixed.join(offsets, [group, "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_part", "_first", "_before")
