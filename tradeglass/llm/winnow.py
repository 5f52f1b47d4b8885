"""Passages of a benchmark inside documents, found by winnowed fingerprints and confirmed on words.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased (A-Z) texts. A window is WINDOW consecutive
words of an item; an item of fewer words is one window of its own length t. Winnowing with k = t // 2 + 1
keeps the (rightmost) smallest k-gram hash of every t - k + 1 consecutive ones, so any shared span of t words
keeps a k-gram in common on both sides: nothing of that length is missed.

Fingerprints of items are a distinct table. Documents drop theirs against a bitmap of it first (of a bounded
size, so its false hits grow with the benchmark, never its misses), then by a join. A hit is extended by the
t - k words on either side: the windows around it are joined, word for word, with the distinct windows
of the benchmark. Both joins meet one row a key at most, so a passage that a third of documents and
many items share makes no pairs. Items are listed once per distinct set of windows, not once per document.

Odd inputs: null texts and texts without words hold nothing; rows that repeat a doc_id are rows of their own; an
item_id that repeats is one item with the windows of all its rows; an item without item_id is hit
but not listed; other columns are ignored; empty documents give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass.llm.words import LOWER, _marks, chunks, mix, span_hashes
from tradeglass.session import stored

WINDOW = 10
#: Bits of the bitmap: BITS_PER_PRINT for each fingerprint, in a power of two up to 16 MB.
BITS_PER_PRINT, LEAST_BITS, MOST_BITS = 16, 15, 27
_ODD = np.random.default_rng(13).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x80] = [chr(c).isdigit() or chr(c).islower() for c in range(0x80)]


def gram(t: int) -> int:
    """Words of a fingerprint where windows have t words."""
    return t // 2 + 1


class Words:
    """The words of a run of documents, by position: spans of the lower-cased bytes, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        inside = _IN_WORD[self.low]
        self.starts, self.ends = _marks(inside, offsets)
        self.hashes = span_hashes(self.low, inside, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)

    def text(self, first: int, last: int) -> str:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)).decode()

    def prints(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and values (signed 64 bits) of the fingerprints of windows of t words."""
        k, n = gram(t), len(self.hashes)
        grams = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            grams += mix(self.hashes[j:j + len(grams)] ^ _ODD[j]) * _ODD[-1 - j]
        grams = mix(grams ^ np.uint64(t))
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n)
        place = np.flatnonzero(left >= t)
        if not len(place):
            return place, grams[:0].view(np.int64)
        first, least = place, grams[place]
        for j in range(1, t - k + 1):
            further = grams[first + j]
            lower = further <= least
            least, place = np.where(lower, further, least), np.where(lower, first + j, place)
        place = np.unique(place)
        return place, grams[place].view(np.int64)


def _worded(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    for first, data, offsets in chunks(texts):
        yield first, Words(data, offsets)


_ITEM = "item string, t int, windows array<string>, prints array<long>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words in _worded(batch.column(1)):
            own = {t: dict(zip(*map(np.ndarray.tolist, words.prints(t)), strict=True)) for t in range(1, WINDOW + 1)}
            for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                t = min(WINDOW, b - a)
                windows = [words.text(j, j + t) for j in range(a, b - t + 1)] if t else []
                prints = [own[t][j] for j in range(a, b) if j in own[t]] if t else []
                yield pa.record_batch([batch.column(0).slice(first + i, 1), pa.array([t], pa.int32()), pa.array([windows], pa.list_(pa.string())),
                                       pa.array([prints], pa.list_(pa.int64()))], ["item", "t", "windows", "prints"])


_HIT = pa.struct([("t", pa.int32()), ("print", pa.int64()), ("at", pa.int64()), ("near", pa.string())])
_MARKED = "doc_id string, n_words long, hits array<struct<t:int,print:long,at:long,near:string>>"


def _hits(lengths: list[int], bitmap, bits: int):
    """Per document its number of words, and the fingerprints that the bitmap knows with the words around them."""
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for first, words in _worded(batch.column(1)):
                n = len(words.bounds) - 1
                found: list[list[dict]] = [[] for _ in range(n)]
                for t in lengths:
                    places, prints = words.prints(t)
                    bit = prints.view(np.uint64) >> np.uint64(64 - bits)
                    keep = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    places, prints = places[keep], prints[keep]
                    docs = np.searchsorted(words.bounds, places, "right") - 1
                    for place, value, doc in zip(places.tolist(), prints.tolist(), docs.tolist(), strict=True):
                        a, b = int(words.bounds[doc]), int(words.bounds[doc + 1])
                        begin, end = max(a, place - t + gram(t)), min(b, place + t)
                        found[doc].append({"t": t, "print": value, "at": begin - a, "near": words.text(begin, end)})
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(np.diff(words.bounds), pa.int64()), pa.array(found, pa.list_(_HIT))],
                                      ["doc_id", "n_words", "hits"])
    return hits


def _bitmap(prints: DataFrame) -> tuple[bytes, int]:
    """The bitmap of fingerprints by their leading bits, and the number of those bits."""
    bits = max(LEAST_BITS, min(MOST_BITS, (BITS_PER_PRINT * prints.count()).bit_length()))
    bit = F.expr(f"shiftrightunsigned(print, {64 - bits})")
    parts = prints.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map"))
    whole = np.zeros(1 << bits - 3, np.uint8)
    for part in parts.collect():  # at most 2 ** (bits - 15) rows of 4096 bytes
        whole[part["part"] * 4096:part["part"] * 4096 + 4096] = np.frombuffer(part["map"], np.uint8)
    return whole.tobytes(), bits


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (start and end of every run of hit words, in order), items (ids as strings, sorted) of every document."""
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(_items, _ITEM), "items")
    prints = stored(items.select(F.explode("prints").alias("print")).distinct(), "prints")
    owners = stored(items.select("item", F.explode("windows").alias("window")).distinct(), "owners")
    windows = stored(owners.select("window").distinct(), "windows")
    lengths = sorted(r.t for r in items.where("t > 0").select("t").distinct().collect())  # at most WINDOW numbers
    bitmap, bits = _bitmap(prints)

    kind = docs.schema[doc_id].dataType
    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = stored(read.mapInArrow(_hits(lengths, spark.sparkContext.broadcast(bitmap), bits), _MARKED).withColumn("row", F.monotonically_increasing_id()), "marked")
    hits = marked.where(F.size("hits") > 0).select("row", F.inline("hits")).join(prints, "print", "left_semi")
    near = hits.select("row", "t", "at", F.split("near", " ").alias("words"))
    probes = near.where(F.size("words") >= F.col("t")).select("row", "t", "at", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("t"))).alias("skip"))
    probes = probes.select("row", (F.col("at") + F.col("skip")).alias("start"), (F.col("at") + F.col("skip") + F.col("t")).alias("end"),
                           F.array_join(F.slice("words", F.col("skip") + 1, F.col("t")), " ").alias("window"))
    found = stored(probes.join(windows, "window", "left_semi").dropDuplicates(["row", "start", "end"]), "found")

    in_order = Window.partitionBy("row").orderBy("start", "end")
    apart = F.col("start") > F.coalesce(F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = found.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(in_order))
    runs = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # documents with the same windows hold the same items
    sets = found.groupBy("row").agg(F.sort_array(F.collect_set("window")).alias("windows")).withColumn("same", F.sha2(F.array_join("windows", "\n"), 256))
    sets = stored(sets, "window-sets")
    once = sets.groupBy("same").agg(F.min("windows").alias("windows")).select("same", F.explode("windows").alias("window"))
    listed = once.join(owners.where("item IS NOT NULL"), "window").groupBy("same").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = stored(spans.join(sets.select("row", "same"), "row").join(listed, "same", "left").select("row", "spans", "items"), "hit")
    none = "CAST(array() AS array<struct<start:bigint,end:bigint>>)"
    return marked.select("row", "doc_id", "n_words").join(hit, "row", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_words", F.coalesce("spans", F.expr(none)).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))
