"""Merging nested records: a base keeps what it says, a fallback fills what it leaves empty.

A record is a VARIANT. Both records become rows of (path, leaf): scalars, lists as wholes and empty objects are
leaves. A fallback leaf counts where the base has nothing, or something empty (null, empty text, list or object),
at its path or above it, and no object there. The leaves that count are folded back into JSON, deepest level
first, one aggregate a level; a record is a document, so its rows are few whatever the number of records.

Odd inputs: a null record is an empty one; two scalars at the top give the base's unless it is empty; repeated ids are not
allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass.session import stored

EMPTY = ["null", '""', "[]", "{}"]


def leaves(rows: DataFrame, record: str) -> DataFrame:
    """id, path (array of keys), leaf (JSON text) of every leaf of a record; a level of nesting is a round."""
    fields = "try_variant_get(v, '$', 'map<string,variant>')"
    nodes = rows.selectExpr("id", "cast(array() AS array<string>) AS path", f"coalesce({record}, parse_json('null')) AS v")
    out = None
    while True:
        level = stored(nodes.selectExpr("id", "path", "v", f"coalesce(size({fields}), 0) > 0 AS inner"), "record-level")
        own = level.where("NOT inner").selectExpr("id", "path", "to_json(v) AS leaf")
        out = own if out is None else out.unionByName(own)
        nodes = level.where("inner")
        if nodes.isEmpty():
            return out
        nodes = nodes.selectExpr("id", "path", f"explode({fields}) AS (key, child)").selectExpr("id", "concat(path, array(key)) AS path", "child AS v")


def _above(paths: DataFrame) -> DataFrame:
    """Every path with its proper beginnings."""
    return paths.selectExpr("id", "path", "explode(transform(sequence(0, size(path)), n -> slice(path, 1, n))) AS upper").where("size(upper) < size(path)")


def merged_leaves(rows: DataFrame, base: str = "base", fallback: str = "fallback") -> DataFrame:
    """id, path, leaf of the merged record of every row (id, base, fallback)."""
    b, f = stored(leaves(rows, base), "base-leaves"), stored(leaves(rows, fallback), "fallback-leaves")
    empty = F.col("leaf").isin(*EMPTY)
    told = b.where(~empty).select("id", "path")
    inside = _above(b).select("id", F.col("upper").alias("path")).distinct()  # objects of the base that hold something
    # a fallback leaf is out where the base has a telling leaf or an object at its path, or a telling leaf above it
    blocked = _above(f).join(told.withColumnRenamed("path", "upper"), ["id", "upper"], "left_semi").select("id", "path").distinct()
    filling = f.join(told, ["id", "path"], "left_anti").join(inside, ["id", "path"], "left_anti").join(blocked, ["id", "path"], "left_anti")
    # an empty base leaf gives way to what the fallback says at its path or below
    covers = filling.select("id", "path").unionByName(_above(filling).select("id", F.col("upper").alias("path"))).distinct()
    kept = b.join(told, ["id", "path"], "left_semi").unionByName(b.where(empty).join(covers, ["id", "path"], "left_anti"))
    return kept.unionByName(filling)


def merge_missing(rows: DataFrame, base: str = "base", fallback: str = "fallback") -> DataFrame:
    """id, merged (VARIANT) of every row (id, base, fallback)."""
    parts = stored(merged_leaves(rows, base, fallback), "merged-leaves")
    deepest = parts.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        now = parts.where(F.size("path") == depth).selectExpr("id", "slice(path, 1, size(path) - 1) AS path", "concat(to_json(cast(path[size(path) - 1] AS variant)), ':', leaf) AS member")
        folded = now.groupBy("id", "path").agg(F.expr("concat('{', array_join(array_sort(collect_list(member)), ','), '}') AS leaf"))
        parts = parts.where(F.size("path") < depth).unionByName(folded)
    return parts.selectExpr("id", "parse_json(leaf) AS merged")
