"""Vectorised segmentation and hashing of whole texts.

Texts are taken as Arrow string arrays; work is done over their byte buffers in chunks of whole
documents, so memory follows the chunk (or one long document), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACES = [0x20, *range(0x09, 0x0E)]
SPACE = np.zeros(256, bool)
SPACE[_SPACES] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096)
        table = np.full(size, _BASE & 0xFFFFFFFFFFFFFFFF, np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of len(rows)+1) of runs of whole documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def _marks(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside; documents, and the positions in cut, begin new runs."""
    n = len(inside)
    begin = np.ones(n, bool)
    begin[1:] = ~inside[:-1]
    begin[offsets[:-1][offsets[:-1] < n]] = True
    if cut is not None:
        begin |= cut
    begin &= inside
    starts = np.flatnonzero(begin)
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:] | begin[1:]
    edges = offsets[1:] - 1
    stop[edges[edges >= 0]] = True
    return starts, np.flatnonzero(stop & inside) + 1


def span_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial over random byte codes, finalised with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = _power_table(int(lengths.max()))
    packed = data[inside]
    own = np.cumsum(lengths) - lengths
    place = np.arange(len(packed), dtype=np.int32) - np.repeat(own.astype(np.int32), lengths)
    sums = np.add.reduceat(_CODES[packed] * powers[place], own)
    return mix(sums ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of lower-cased (A-Z) texts, and each document's offsets into them."""
    low = LOWER[data]
    inside = ~SPACE[data]
    starts, ends = _marks(inside, offsets)
    return span_hashes(low, inside, starts, ends), np.searchsorted(starts, offsets)


def words_of(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, document offsets) per chunk of documents."""
    for first, data, offsets in chunks(texts, limit):
        hashes, bounds = word_hashes(data, offsets)
        yield first, hashes, bounds


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated index ranges [start, start + length)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
