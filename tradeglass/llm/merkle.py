"""A Merkle manifest: a tree of SHA-256 digests over ordered rows, and the proof of every row.

Leaves of a group stand in order; every ARITY consecutive nodes (the last run has fewer, even one)
become the digest of their concatenated hex texts, while more than one node remains. The roots of the
groups, in order of the group's name, are the leaves of a like tree, whose root names the data set.

Concatenated-level strings: BLOCK = ARITY ** 3 consecutive nodes of a group are one row. Each of their
levels is one string of hex digests, 64 characters a node; a parent is the digest of a fixed-width substring,
and the siblings of a node are the substrings that flank it. The roots of blocks are nodes again, until each
group has one, so a group of any size is a few rounds of blocks, and no row grows with a group. The way from a
block to the root is found once for the block, from the top down.

Odd inputs: a null group comes first; rows of equal order are put by leaf, so rows that repeat are
interchangeable; a lone leaf is its group's root and has an empty path; an empty table gives no rows; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeglass.llm.ranked import group_name, ranked
from tradeglass.session import stored

ARITY, LEVELS, HEX = 8, 3, 64
BLOCK = ARITY ** LEVELS
_NO_PATH = "CAST(array() AS array<struct<left:string,right:string>>)"


def digest(*columns: str | Column) -> Column:
    """SHA-256 of the columns' canonical texts: `-` for null, else UTF-8 byte count, colon, value."""
    def piece(column: str | Column) -> Column:
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(piece, columns)), 256)


def _parents(level: str) -> Column:
    """The next level's string: a digest of every fixed-width substring of ARITY nodes."""
    width = ARITY * HEX
    return F.expr(f"array_join(transform(sequence(1, length({level}), {width}), at -> sha2(substring({level}, at, {width}), 256)), '')")


def _blocks(nodes: DataFrame) -> DataFrame:
    """_group, block, size, members, level strings, height and root of every run of BLOCK nodes."""
    members = F.sort_array(F.collect_list(F.struct("place", "node", "row")))
    blocks = nodes.groupBy("_group", F.floor(F.col("place") / BLOCK).alias("block"), "size").agg(members.alias("members"))
    blocks = blocks.withColumn("level0", F.expr("array_join(transform(members, m -> m.node), '')"))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", _parents(f"level{k}"))
    height = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        height = F.when(F.col("size") <= ARITY ** k, k).otherwise(height)
    root = F.element_at(F.array(*(f"level{k}" for k in range(LEVELS + 1))), F.col("height") + 1)
    return blocks.withColumn("height", height).withColumn("root", root).withColumn(
        "members", F.expr("transform(members, m -> struct(m.place AS place, m.row AS row))"))


def _siblings(k: int) -> Column:
    """Segments that flank a member's node of level k in its run."""
    at = f"(m.place % {BLOCK}) DIV {ARITY ** k}"
    first = f"CAST(({at} - {at} % {ARITY}) * {HEX} + 1 AS int)"
    own = f"CAST(({at} % {ARITY}) * {HEX} AS int)"
    return F.expr(f"struct(substring(level{k}, {first}, {own}) AS left, "
                  f"substring(level{k}, {first} + {own} + {HEX}, {ARITY * HEX - HEX} - {own}) AS right)")


def _tree(nodes: DataFrame, above) -> DataFrame:
    """row, place, _group, subroot, root, path of every node (_group, place, size, node, row).

    above gives (_group, root, path) of the groups' roots (_group, subroot).
    """
    levels = []
    while True:
        levels.append(stored(_blocks(nodes), "blocks"))
        large = levels[-1].where(F.col("size") > BLOCK)
        if large.isEmpty():
            break
        nodes = large.select("_group", F.col("block").alias("place"), F.ceil(F.col("size") / BLOCK).alias("size"),
                             F.col("root").alias("node"), F.lit(None).cast("int").alias("row"))
    ended = [blocks.where(F.col("size") <= BLOCK).select("_group", F.col("root").alias("subroot")) for blocks in levels]
    roots = ended[0]
    for more in ended[1:]:
        roots = roots.unionByName(more)
    tops = above(roots)
    rows = None
    for blocks, end in zip(reversed(levels), reversed(ended), strict=True):
        ways = end.join(tops, "_group").withColumn("block", F.lit(0).cast("long"))
        if rows is not None:
            ways = ways.unionByName(rows.select("_group", "subroot", "root", "path", F.col("place").alias("block")))
        ways = stored(ways.select("_group", "block", "subroot", F.col("root").alias("top"), "path"), "ways")
        opened = blocks.join(ways, ["_group", "block"]).withColumn("m", F.explode("members"))
        own = F.slice(F.array(*map(_siblings, range(LEVELS))), 1, F.col("height"))
        rows = opened.select(F.col("m.row").alias("row"), F.col("m.place").alias("place"), "_group", "subroot",
                             F.col("top").alias("root"), F.concat(own, "path").alias("path"))
    return rows


def _whole(roots: DataFrame) -> DataFrame:
    """(_group, root, path) of the groups' roots in the tree over them."""
    named = stored(roots.select(F.lit("").alias("_all"), F.col("_group").alias("row"), F.col("subroot").alias("node")), "subroots")
    nodes = ranked(named, "_all", ["row", "node"]).withColumnRenamed("_all", "_group")
    single = lambda ended: ended.select("_group", F.col("subroot").alias("root"), F.expr(_NO_PATH).alias("path"))
    return stored(_tree(nodes, single).select(F.col("row").alias("_group"), "root", "path"), "tops")


def proofs(rows: DataFrame, leaf: str, group: str, order: str) -> DataFrame:
    """All columns of the rows as `row`, with subroot, root and path.

    path holds, from the leaf upwards, the segments of sibling digests left and right of the way to the root.
    """
    packed = rows.select(group_name(group).alias("_group"), F.col(order).alias("_order"), F.col(leaf).alias("node"),
                         F.monotonically_increasing_id().alias("_id"), F.struct(*(f"`{c}`" for c in rows.columns)).alias("row"))
    nodes = ranked(stored(packed, "leaves"), "_group", ["_order", "node", "_id"]).drop("_order", "_id")
    return _tree(nodes, _whole).select("row", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, way: F.sha2(F.concat(way["left"], node, way["right"]), 256))


def segments(path: Column) -> Column:
    """All sibling digests of a path in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda way: F.concat(way["left"], way["right"])), "")
