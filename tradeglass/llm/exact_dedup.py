"""Exact duplicates by an index of cuckoo filters.

Texts are named by their SHA-256 and byte length. The index is spread over partitions by digest. Each
partition holds a cuckoo filter of 16-bit fingerprints, two candidate buckets of four slots per key,
beside the bucketed keys themselves. A fingerprint hit counts only when the bucketed key is the
same. Live digests can be deleted. When an insertion runs out of kicks the table doubles and is
filled again from the stored keys. Rows are folded once where they are read, so the copies of one
text reach its partition as at most one row per reading task and LOCAL_KEYS digests.

Odd inputs: a null text counts as empty. The largest non-null doc_id of a group stays; where all are
null, keep_id is null and the null rows are kept. Rows that repeat a doc_id and text all count in
group_size and share kept; unique() leaves one of them. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, KICKS, LOCAL_KEYS = 4, 200, 100_000
_SPREAD = 0x5BD1E995


class CuckooIndex:
    """Live keys (bytes that are already uniform) with a largest id and a count each."""

    def __init__(self, buckets: int = 1 << 10):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = np.zeros(buckets * SLOTS, np.uint16).tolist()
        self.entries: list[list | None] = [None] * (buckets * SLOTS)
        self.live = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print(key)
        one = int.from_bytes(key[:8], "little") & self.mask
        return mark, one, one ^ (mark * _SPREAD & self.mask)

    def _slot(self, key: bytes) -> int:
        """Slot of a live key, else -1: fingerprints first, then the bucketed key itself."""
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.entries[at][0] == key:
                    return at
        return -1

    def _place(self, entry: list) -> list | None:
        """Put an entry, kicking others on; returns what found no slot."""
        mark, one, two = self._places(entry[0])
        bucket = one
        for kick in range(KICKS):
            for target in (bucket, bucket ^ (mark * _SPREAD & self.mask)):
                for at in range(target * SLOTS, target * SLOTS + SLOTS):
                    if not self.prints[at]:
                        self.prints[at], self.entries[at] = mark, entry
                        return None
            at = (bucket ^ (mark * _SPREAD & self.mask)) * SLOTS + kick % SLOTS
            bucket = at // SLOTS
            self.prints[at], mark = mark, self.prints[at]
            self.entries[at], entry = entry, self.entries[at]
        return entry

    def _insert(self, entry: list) -> None:
        left = self._place(entry)
        if left is None:
            self.live += 1
            return
        waiting = [*self.rows(), left]
        while left is not None:  # overflow: fill a table twice as large from the stored keys
            self._reset((self.mask + 1) * 2)
            left = next((x for x in map(self._place, waiting) if x is not None), None)
        self.live = len(waiting)

    def add(self, key: bytes, best: int | None, count: int = 1) -> bool:
        """Count a key; True if it was new."""
        at = self._slot(key)
        if at >= 0:
            entry = self.entries[at]
            entry[2] += count
            if best is not None and (entry[1] is None or best > entry[1]):
                entry[1] = best
            return False
        self._insert([key, best, count])
        return True

    def remove(self, key: bytes) -> bool:
        """Delete a live key; False if there was none."""
        at = self._slot(key)
        if at < 0:
            return False
        self.prints[at], self.entries[at] = 0, None
        self.live -= 1
        return True

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) >= 0

    def rows(self) -> list[list]:
        return [e for e in self.entries if e is not None]


_SCHEMA = pa.schema([("key", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_DDL = "key binary, keep_id long, group_size long"


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = index.rows()
    for at in range(0, len(rows), 10_000):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 10_000], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _fold(limit: int | None):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, best, count, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if removed:
                    index.remove(key)
                else:
                    index.add(key, best, count)
            if limit and index.live > limit:
                yield from _rows(index)
                index = CuckooIndex()
        yield from _rows(index)
    return fold


def text_key(text: str) -> Column:
    """SHA-256 of the text's UTF-8 bytes, then its byte length."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.concat(F.unhex(F.sha2(whole, 256)), F.unhex(F.lpad(F.hex(F.octet_length(whole).cast("long")), 16, "0")))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size of every distinct text."""
    rows = docs.select(text_key(text).alias("key"), F.col(doc_id).cast("long").alias("keep_id"),
                       F.lit(1).cast("long").alias("group_size"), F.lit(False).alias("removed"))
    local = rows.mapInArrow(_fold(LOCAL_KEYS), _DDL).withColumn("removed", F.lit(False))
    return local.repartition("key").mapInArrow(_fold(None), _DDL)


def change_index(index: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """An index with further documents counted in and then the keys of `removed` deleted."""
    rows = index.select("key", "keep_id", "group_size", F.lit(False).alias("removed")).unionByName(
        build_index(added).withColumn("removed", F.lit(False)))
    if removed is not None:
        rows = rows.unionByName(removed.select("key", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("removed")))
    return rows.repartition("key").sortWithinPartitions("removed").mapInArrow(_fold(None), _DDL)


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    The rows of one text may be a third of the table; they are narrow, and adaptive execution splits them.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key"))
    return narrow.join(build_index(docs, doc_id, text), "key").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns unchanged; one row of those that repeat a doc_id and text."""
    name = F.col(doc_id).cast("long")
    kept = build_index(docs, doc_id, text).select(F.col("key").alias("_key"), F.coalesce("keep_id", F.lit(0)).alias("_keep"), F.col("keep_id").isNull().alias("_none"))
    keyed = docs.withColumns({"_key": text_key(text), "_keep": F.coalesce(name, F.lit(0)), "_none": name.isNull()})
    # the copies of one text differ in doc_id, so they spread; the join's partitioning serves both steps
    return keyed.join(kept, ["_key", "_keep", "_none"], "left_semi").dropDuplicates(["_key", "_keep", "_none"]).drop("_key", "_keep", "_none")
