"""Packing token sequences into windows by multiway differencing (Karmarkar-Karp).

Every document's ids are cut into whole windows and a rest; whole windows are sequences of their own.
Rests are cut into pieces of at most PIECE ids and collected in groups of about GROUP_WINDOWS windows.
A group starts as one partial partition per piece. The two partial partitions with the largest spreads
are merged, the heaviest windows of one onto the lightest of the other, until one is left. Its windows
differ by few ids. If the heaviest is over capacity, the window count rises by one and the group is
partitioned anew. Groups form within a Spark partition, so nothing is shuffled and memory is bounded
by the group.

Odd inputs: a null or empty text has only its end id and is packed like any other; rows that repeat a
document id are packed one by one; a null document id stays null; no rows give no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass.llm.pieces import document_ids, library_table

CAPACITY, PIECE, GROUP_WINDOWS = 2048, 256, 128


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k-1) of every size, with near-equal window sums.

    A partial partition is (window sums in falling order, less their minimum once there are k; a tree node
    per window). Windows that hold nothing yet are left out.
    """
    n = len(sizes)
    if k <= 1:
        return np.zeros(n, np.int64)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    firsts: list[np.ndarray] = []
    seconds: list[np.ndarray] = []
    node = order = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        b, b_nodes = b[::-1], b_nodes[::-1]
        both = len(a) + len(b) - k
        if both <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            cut = len(a) - both
            merged = np.arange(node, node + both)
            node += both
            firsts.append(a_nodes[cut:])
            seconds.append(b_nodes[:both])
            sums = np.concatenate([a[:cut], a[cut:] + b[:both], b[both:]])
            nodes = np.concatenate([a_nodes[:cut], merged, b_nodes[both:]])
        falling = np.argsort(-sums, kind="stable")
        sums, nodes = sums[falling], nodes[falling]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, nodes))
        order += 1
    window = np.zeros(node, np.int64)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    at = node
    for first, second in zip(reversed(firsts), reversed(seconds), strict=True):
        at -= len(first)
        window[first] = window[second] = window[at:at + len(first)]
    return window[:n]


def windows_of(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(window of every size, window count); no window exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, k).max() <= capacity:
            return window, k
        k += 1


class _Group:
    """Pieces waiting for a partition."""

    def __init__(self, capacity: int):
        self.capacity, self.pieces, self.total = capacity, [], 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.total += len(piece[2])

    def full(self) -> bool:
        """Large enough, with a few ids of room for each window, so the first window count mostly holds."""
        windows = -(-self.total // self.capacity)
        room = windows * self.capacity - self.total
        return windows >= GROUP_WINDOWS and (4 * windows <= room <= self.capacity // 2 + 4 * windows or windows >= 2 * GROUP_WINDOWS)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 32
        group = _Group(capacity)

        def close() -> pa.RecordBatch:
            nonlocal group, sequence
            sizes = np.array([len(p[2]) for p in group.pieces], np.int64)
            window, k = windows_of(sizes, capacity)
            used = np.unique(window)
            order = np.argsort(window, kind="stable")
            run = np.cumsum(sizes[order]) - sizes[order]
            first = np.searchsorted(window[order], window[order], "left")
            offsets = run - run[first]
            rows = [(*group.pieces[i], sequence + int(np.searchsorted(used, window[i])), int(o)) for i, o in zip(order.tolist(), offsets.tolist(), strict=True)]
            sequence += len(used)
            group = _Group(capacity)
            return _batch(rows)

        for batch in batches:
            whole: list[tuple] = []
            held = 0
            for name, ids in zip(batch.column(0).to_pylist(), document_ids(table, batch.column(1), end_id), strict=True):
                full = len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    whole.append((name, at, ids[at:at + capacity], len(ids), sequence, 0))
                    sequence += 1
                held += full
                for at in range(full, len(ids), piece):
                    group.add((name, at, ids[at:at + piece].copy(), len(ids)))
                if group.full():
                    yield close()
                if held > 1 << 21:
                    yield _batch(whole)
                    whole, held = [], 0
            if whole:
                yield _batch(whole)
        if group.pieces:
            yield close()

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, starts, ids, totals, sequences, offsets = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(totals, pa.int64()),
                            pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], schema=_SCHEMA)
