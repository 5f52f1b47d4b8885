"""Near duplicates by fast similarity sketches, banding and exact verification.

A document's set holds the distinct runs of SHINGLE words of its lower-cased (A-Z) text; with fewer words the
whole sequence is its one element. Words and shingles are named by 64-bit hashes.

Fast similarity sketching: in round i every element is thrown into one of COORDINATES bins by a hash of
its own, and a bin that is still empty takes the smallest hash that fell in. After COORDINATES such
rounds, round COORDINATES + j throws all elements into bin j, so every coordinate fills. Documents that are
full drop out, so a set of n elements costs about max(n, COORDINATES log COORDINATES).

Bands of at most ROWS coordinates name buckets, as many as the asked similarity needs (32 of 6 at 0.85, 38 of
5 at 0.80). Documents with equal sets are one node. Within a bucket
(cut into cells of bounded blocks) the sketches estimate the similarity of pairs whose nodes are not yet
joined; each component names its best partners, those pairs are confirmed on full sets, and confirmed
links are joined into components. The number of partners grows by rounds. In the last round the texts of
all nodes that still have such a partner go to their cells, where every pair left is compared, likeliest
first, while its nodes are apart; a cell gives out only links that join, fewer than it has nodes. So
no pair above the estimate's bound goes unconfirmed while its nodes are apart, and no list of pairs
grows with the square of a group.

Miss probability at the asked similarity: 3e-7 for the bands, about 1e-5 for the estimate's bound (4.3
standard deviations), both per link and only where no other link joins the two nodes.

Odd inputs: null, empty and blank texts have an empty set and link with nothing; rows that repeat a
doc_id each get the component of their own text; a row without doc_id takes part in links, gets the
component of its text (null if that has no id at all) and is not kept; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeglass.llm.components import cells, connected
from tradeglass.llm.grouped import by_cell, emit
from tradeglass.llm.words import mix, ranges, words_of
from tradeglass.session import stored

SHINGLE, COORDINATES, ROWS, MISSED, BLOCK, PERCENT = 5, 256, 6, 3e-7, 1024, 85
#: Best partners a node names in a cell, by round; the last round compares all pairs in their cells.
PARTNERS = (1, 8)
#: Shingles of a block in the last round, where cells hold texts.
BLOCK_SHINGLES = 2_000_000
_ODD = np.random.default_rng(5).integers(1, 1 << 63, (2 * COORDINATES + SHINGLE,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, bounds in words_of(texts):
        n = len(words)
        runs = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            runs += mix(words[k:k + len(runs)] ^ _ODD[k]) * _ODD[-1 - k]
        runs = mix(runs)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(runs[a:b - SHINGLE + 1])
            elif b > a:
                yield mix(np.array([b - a], np.uint64) ^ np.bitwise_xor.reduce(mix(words[a:b] * _ODD[:b - a])))
            else:
                yield np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES bytes per set; rows of empty sets are zero."""
    t = COORDINATES
    out = np.zeros((len(sets), t), np.uint8)
    lengths = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    open_bins = np.ones((len(sets), t), bool)
    live = np.flatnonzero(lengths)
    for turn in range(2 * t):
        if not len(live):
            break
        own = lengths[live]
        x = mix(flat[ranges(starts[live], own)] ^ _ODD[turn])
        row = np.repeat(np.arange(len(live)), own)
        bin_ = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if turn < t else np.full(len(x), turn - t)
        least = np.full(len(live) * t, _EMPTY, np.uint64)
        np.minimum.at(least, row * t + bin_, x << np.uint64(32) if turn < t else x)
        least = least.reshape(len(live), t)
        new = (least != _EMPTY) & open_bins[live]
        at = np.nonzero(new)
        out[live[at[0]], at[1]] = (mix(least[at] ^ _ODD[turn]) >> np.uint64(56)).astype(np.uint8)
        open_bins[live[at[0]], at[1]] = False
        live = live[open_bins[live].any(1)]
    return out


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: list[np.ndarray] = []
        done = size = 0

        def flush(names: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            rows = sketches(sets)
            return emit(_SKETCHED, names, [len(s) for s in sets],
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [r.tobytes() for r in rows])

        for s in shingle_sets(batch.column(1)):
            sets.append(s)
            size += len(s)
            if size > 100_000 or len(sets) >= 512:
                yield flush(batch.column(0).slice(done, len(sets)), sets)
                done, size, sets = done + len(sets), 0, []
        if sets:
            yield flush(batch.column(0).slice(done, len(sets)), sets)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cell", pa.int64())])
_ENDS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def least_equal(percent: int) -> int:
    """Fewest equal coordinates of a pair worth confirming: the asked share of all, less 4.3 standard deviations."""
    share = percent / 100
    return max(0, int(COORDINATES * share - 4.3 * (COORDINATES * share * (1 - share)) ** 0.5))


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: the most rows, and for them the fewest bands, that miss a pair with probability MISSED at most."""
    for rows in range(ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log(apart)) if apart else 1
        if bands * rows <= COORDINATES:
            return bands, rows
    return COORDINATES, 1


def _best(ends: list[np.ndarray], cell: np.ndarray, equal: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs among the k best of either end (an end of -1 names none)."""
    chosen = []
    for end in ends:
        order = np.lexsort((-equal, end, cell))
        order = order[end[order] >= 0]
        own, where = end[order], cell[order]
        begin = np.ones(len(order), bool)
        begin[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
        chosen.append(order[place < k])
    return np.unique(np.concatenate(chosen))


def _near(table: pa.Table, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs worth confirming within the cells of a table, and their equal coordinates.

    A pair counts in the first band that its two nodes share, and only while their labels differ.
    """
    least, (n_bands, n_rows) = least_equal(percent), banding(percent)
    label, band, mine, low, high = (table.column(c).to_numpy() for c in ("label", "band", "mine", "low", "high"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    none = np.zeros(0, np.int64)
    found, small = [(none, none, none)], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if low[a] == high[a] and b - a <= 32:
            i, j = np.triu_indices(b - a, 1)
            small.append((a + i, a + j))
            continue
        left, right = a + np.flatnonzero(mine[a:b] == low[a]), a + np.flatnonzero(mine[a:b] == high[a])
        found.append(_across(left, right, sketch, label, low[a] == high[a], least))
    if small:
        u, v = (np.concatenate(x) for x in zip(*small, strict=True))
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
        equal = np.concatenate([(sketch[u[i:i + 8192]] == sketch[v[i:i + 8192]]).sum(1) for i in range(0, len(u), 8192)] or [none])
        keep = equal >= least
        found.append((u[keep], v[keep], equal[keep]))
    u, v, equal = (np.concatenate(x) for x in zip(*found, strict=True))
    bands = sketch[:, :n_bands * n_rows].reshape(-1, n_bands, n_rows)
    shared = np.concatenate([(bands[u[i:i + 8192]] == bands[v[i:i + 8192]]).all(2).argmax(1) for i in range(0, len(u), 8192)] or [none])
    first = shared == band[u]
    return u[first], v[first], equal[first]


def _candidates(k: int, percent: int):
    """Pairs worth confirming of sorted rows (cell, mine, low, high, band, node, label, sketch).

    The k best pairs of a label are named by the labels other than the cell's largest: one end of every
    pair is such a label.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in by_cell(batches, "cell"):
            u, v, equal = _near(table, bounds, percent)
            if len(u):
                node, cell = table.column("node").to_numpy(), table.column("cell").to_numpy()
                named = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if b - a > 32:
                        own, counts = np.unique(named[a:b], return_counts=True)
                        if counts.max() > 1:
                            named[a:b][named[a:b] == own[counts.argmax()]] = -1
                best = _best([named[u], named[v]], cell[u], equal, k)
                u, v = u[best], v[best]
                yield emit(_PAIRS, np.minimum(node[u], node[v]), np.maximum(node[u], node[v]), cell[u])
    return pairs


_OPEN = pa.schema([("cell", pa.int64()), ("node", pa.int64())])


def _undecided(percent: int):
    """(cell, node) of the nodes with a pair worth confirming in a cell, of rows as in _candidates."""
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in by_cell(batches, "cell"):
            u, v, _ = _near(table, bounds, percent)
            if len(u):
                at = np.unique(np.concatenate([u, v]))
                yield emit(_OPEN, table.column("cell").to_numpy()[at], table.column("node").to_numpy()[at])
    return nodes


def _joining(percent: int):
    """Links (u, v) that join labels of a cell, of rows as in _candidates with texts (several where a node has several)."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in by_cell(batches, "cell"):
            u, v, equal = _near(table, bounds, percent)
            node, label = table.column("node").to_numpy(), table.column("label").to_numpy().tolist()
            cell, root, sets, out = table.column("cell").to_numpy(), {}, {}, []
            texts = table.column("text")

            def found(name: tuple[int, int]) -> tuple[int, int]:
                while (above := root.get(name, name)) != name:
                    root[name] = root.get(above, above)
                    name = above
                return name

            def own(at: int) -> np.ndarray:
                if at not in sets:
                    sets[at], = shingle_sets(texts.slice(at, 1).combine_chunks())
                return sets[at]

            last = None
            for i in np.lexsort((-equal, cell[u])).tolist():
                a, b = int(u[i]), int(v[i])
                if cell[a] != last:
                    last, sets = cell[a], {}
                one, two = found((last, label[a])), found((last, label[b]))
                if one != two and _similar(own(a), own(b), percent):
                    root[one] = two
                    out.append((node[a], node[b]))
            if out:
                yield emit(_ENDS, *zip(*out, strict=True))
    return links


def _across(left: np.ndarray, right: np.ndarray, sketch: np.ndarray, label: np.ndarray, same: bool, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different labels whose sketches are near enough, and their equal coordinates."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for place, i in enumerate(left.tolist()):
        others = right[place + 1:] if same else right
        others = others[label[others] != label[i]]
        if len(others):
            equal = (sketch[others] == sketch[i]).sum(1)
            keep = equal >= least
            found.append((np.full(int(keep.sum()), i), others[keep], equal[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_())])


def _confirmed(percent: int):
    """Compare full sets; rows sorted by cell hold a node's text (v null) or a pair (text null)."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in by_cell(batches, "cell"):
            u, v = table.column("u").to_numpy(), table.column("v")
            is_text = np.asarray(v.is_null())
            partner = v.fill_null(0).to_numpy()
            texts = table.column("text")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = a + np.flatnonzero(is_text[a:b])
                sets: dict[int, list[np.ndarray]] = {}
                for name, s in zip(u[rows].tolist(), shingle_sets(texts.take(pa.array(rows)).combine_chunks()), strict=True):
                    sets.setdefault(name, []).append(s)
                at = a + np.flatnonzero(~is_text[a:b])
                linked = [any(_similar(s, t, percent) for s in sets[x] for t in sets[y]) for x, y in zip(u[at].tolist(), partner[at].tolist(), strict=True)]
                if len(at):
                    yield emit(_LINKS, u[at], partner[at], linked)
    return links


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if not len(s) or not len(t) or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= percent * (len(s) + len(t) - common)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links need percent * union <= 100 * intersection."""
    return _marked(docs, doc_id, text, percent).drop("set_key")


def _marked(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """near_duplicates() with the set_key of every row's text."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stored(narrow.mapInArrow(_sketched, "doc_id long, n_shingles long, set_key binary, sketch binary"), "sketches")
    # a set is one node, named by its smallest doc_id, or by its key where no row has one or other sets have the same
    by_key = -1 - F.abs(F.xxhash64("set_key") % F.lit(1 << 61))
    sets = stored(rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("low_id"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n_shingles")), "sets")
    shared = stored(sets.where("low_id IS NOT NULL").groupBy("low_id").count().where("count > 1").select(F.col("low_id").alias("shared_id")), "shared")
    sets = sets.join(shared, F.col("low_id") == F.col("shared_id"), "left").select(
        "set_key", "low_id", "sketch", "n_shingles", F.when(F.col("low_id").isNull() | F.col("shared_id").isNotNull(), by_key).otherwise(F.col("low_id")).alias("node"))

    n_bands, n_rows = banding(percent)
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * n_rows + 1, F.lit(n_rows)))))
    keys = sets.select("node", band.alias("band", "key"))
    shape = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.min("node").alias("low")).where("n > 1")
    # buckets with the same members say the same; that of the first band stays
    chosen = shape.groupBy("n", "mix", "low").agg(F.min(F.struct("band", "key")).alias("first")).select("first.*")
    members = stored(keys.join(chosen, ["band", "key"]).distinct(), "members")

    labels = members.select("node").distinct().withColumn("label", F.col("node"))
    open_members = members
    texts = None
    refuted = None
    one = sets.select("node", "sketch")
    in_cells = ["cell", "mine", "low", "high", "band", "node", "label", "sketch"]

    def still_open() -> DataFrame:
        """The rows of buckets whose nodes have different labels."""
        labelled = open_members.join(labels, "node")
        mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band", "key")
        return stored(labelled.join(mixed, ["band", "key"]), "open")

    for k in PARTNERS:
        labelled = still_open()
        open_members = labelled.select("band", "key", "node")
        dealt = cells(labelled, ["band", "key"], "node", BLOCK).join(one, "node").select(*in_cells)
        found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_candidates(k, percent), "u long, v long, cell long")
        pairs = stored(found.groupBy("u", "v").agg(F.min("cell").alias("cell")), "pairs")
        if pairs.isEmpty():
            break
        if refuted is not None:
            pairs = stored(pairs.join(refuted, ["u", "v"], "left_anti"), "pairs")
            if pairs.isEmpty():  # the last round compares all beyond these
                continue
        if texts is None:  # every node that any later round can name has named its best partner now
            named = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "named")
            texts = stored(_texts_of(narrow, rows, sets, named), "texts")
        wanted = pairs.select("cell", F.col("u").alias("node")).union(pairs.select("cell", "v")).distinct()
        bodies = wanted.join(texts, "node").select("cell", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), "text")
        both = bodies.unionByName(pairs.select("cell", "u", "v", F.lit(None).cast("string").alias("text")))
        checked = stored(both.repartition("cell").sortWithinPartitions("cell").mapInArrow(_confirmed(percent), "u long, v long, linked boolean"), "checked")
        no = checked.where("not linked").select("u", "v")
        refuted = no if refuted is None else refuted.unionByName(no)
        labels = _joined(labels, checked.where("linked").select("u", "v"))
    else:
        sizes = sets.select("node", "n_shingles")
        dealt = stored(cells(still_open().join(sizes, "node"), ["band", "key"], "node", BLOCK, "n_shingles", BLOCK_SHINGLES).join(one, "node").select(*in_cells), "dealt")
        left = stored(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_undecided(percent), "cell long, node long"), "undecided")
        if not left.isEmpty():
            bodies = dealt.join(left, ["cell", "node"]).join(texts, "node").select(*in_cells, "text")
            links = stored(bodies.repartition("cell").sortWithinPartitions("cell").mapInArrow(_joining(percent), "u long, v long"), "links")
            labels = _joined(labels, links)

    joined = sets.join(labels, "node", "left").select("set_key", "low_id", F.coalesce("label", "node").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("low_id").alias("component_id"))
    by_set = joined.join(smallest, "label").select("set_key", "component_id")
    named = rows.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    return named.select("doc_id", "n_shingles", "set_key", F.coalesce("component_id", "doc_id").alias("component_id"),
                        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"))


def _texts_of(narrow: DataFrame, rows: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes: the text of the document a node is named by; where that has no id or several sets, a text with its key."""
    mixed = stored(_mixed(rows), "mixed")
    named = narrow.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").join(mixed, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "text")
    nameless = narrow.where("doc_id IS NULL").unionByName(narrow.join(mixed, "doc_id", "left_semi").select("doc_id", "text"))
    keyed = nameless.select("text").mapInArrow(_keyed, "set_key binary, text string").dropDuplicates(["set_key"])
    return named.unionByName(keyed.join(sets.select("set_key", "node"), "set_key").join(nodes, "node").select("node", "text"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Each doc_id whose rows have different sets."""
    return rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("a"), F.max(F.xxhash64("set_key")).alias("b")).where("a <> b").select("doc_id")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(batch.column(0))]
        yield pa.record_batch([pa.array(keys, pa.binary()), batch.column(0)], ["set_key", "text"])


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the links between labels, laid over the old labels."""
    ends = links.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    across = stored(ends.where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "across")
    if across.isEmpty():
        return labels
    merged = connected(across).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stored(labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, all columns unchanged: the smallest doc_id of every component, and rows without one.

    Where a doc_id repeats with different texts, its rows stay or go by their own text's component.
    """
    marked = _marked(docs, doc_id, text, percent).where("doc_id IS NOT NULL")
    gone = marked.groupBy(F.col("doc_id").alias("_gone")).agg(F.min("kept").alias("all_kept"), F.max("kept").alias("some")).where("NOT all_kept").select("_gone", "some")
    # written first, so that the size of the ids is known before any text is shuffled for the join
    gone = stored(gone, "gone")
    id_ = F.col(doc_id).cast("long")
    left = docs.join(gone, id_ == F.col("_gone"), "left_anti")
    some = gone.where("some").select("_gone")
    if some.isEmpty():
        return left
    keys = stored(marked.where("NOT kept").join(some, F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_gone"), F.col("set_key").alias("_key")).distinct(), "gone-keys")
    own = docs.join(some, id_ == F.col("_gone"), "left_semi").withColumn("_own", _key_of(F.col(text).cast("string")))
    return left.unionByName(own.join(keys, (id_ == F.col("_gone")) & (F.col("_own") == F.col("_key")), "left_anti").drop("_own"))


def _key_of(text: Column) -> Column:
    """The set_key of a text column."""
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(batch)], pa.binary())

    keys.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(keys, "binary")(text)
