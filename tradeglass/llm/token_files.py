"""Token-id files: patched frame-of-reference blocks with a block index.

A file is a run of segments, each followed by one newline byte. Layout of a segment (little-endian):

    magic "TGPF" | u32 documents | u64 ids | u32 blocks | u64 payload bytes | u64 exceptions
    i64 document ids | u8 1 if the document id is null | u32 ids of each document (the end id included)
    block index: u64 start in the payload | u32 minimum | u8 width | u16 exceptions
    payload: per block of 256 ids, (id - minimum) in its lowest `width` bits: whole byte planes, then bit planes
    exceptions: u8 place in the block, u32 (id - minimum) >> width

A block's width is the bit length that holds the PERCENTILE-th of its differences. Blocks start where
the index says, so any block can be read alone. Segments cut between documents and hold about
SEGMENT_IDS ids, a longer document excepted.

Rows with a null document id come first, in any order, and keep their null; a null or empty text has
only its end id; rows that repeat a document id each keep their ids. No rows give no segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeglass.llm.pieces import document_ids, library_table

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 20
#: Bytes of the texts of a part file.
PART_BYTES = 512 << 20
_HEAD = struct.Struct("<4sIQIQQ")
_INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("extra", "<u2")])


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """(index, payload, exception places, exception values) of an id array."""
    blocks = -(-len(ids) // BLOCK)
    index = np.zeros(blocks, _INDEX)
    if not blocks:
        return index, b"", b"", b""
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:len(ids)], full[len(ids):] = ids, ids[-1]
    full = full.reshape(blocks, BLOCK)
    index["low"] = full.min(1)
    full -= index["low"][:, None]
    place = BLOCK * PERCENTILE // 100
    index["width"] = _bit_lengths(np.partition(full, place, axis=1)[:, place])
    above = (full.astype(np.uint64) >> index["width"][:, None].astype(np.uint64)).astype(np.uint32)
    index["extra"] = (above > 0).sum(1)
    sizes = index["width"].astype(np.uint64) * np.uint64(BLOCK // 8)
    index["start"] = np.cumsum(sizes) - sizes
    payload = np.empty(int(sizes.sum()), np.uint8)
    for width in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == width)
        part, planes = full[rows], []
        for shift in range(0, width - 7, 8):
            planes.append((part >> np.uint32(shift)).astype(np.uint8))
        for shift in range(width // 8 * 8, width):
            planes.append(np.packbits((part >> np.uint32(shift)).astype(np.uint8) & 1, axis=1))
        if planes:
            body = np.concatenate(planes, axis=1)
            payload[index["start"][rows].astype(np.int64)[:, None] + np.arange(body.shape[1])] = body
    at = np.nonzero(above)
    return index, payload.tobytes(), at[1].astype(np.uint8).tobytes(), above[at].tobytes()


def unpack_blocks(index: np.ndarray, payload: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the given blocks; payload starts at the first block's start."""
    out = np.zeros((len(index), BLOCK), np.uint32)
    base = index["start"].astype(np.int64) - (int(index["start"][0]) if len(index) else 0)
    for width in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == width)
        body = payload[base[rows][:, None] + np.arange(width * BLOCK // 8)]
        part, at = np.zeros((len(rows), BLOCK), np.uint32), 0
        for shift in range(0, width - 7, 8):
            part |= body[:, at:at + BLOCK].astype(np.uint32) << np.uint32(shift)
            at += BLOCK
        for shift in range(width // 8 * 8, width):
            part |= np.unpackbits(body[:, at:at + BLOCK // 8], axis=1).astype(np.uint32) << np.uint32(shift)
            at += BLOCK // 8
        out[rows] = part
    row = np.repeat(np.arange(len(index)), index["extra"])
    out[row, places] |= values << index["width"][row].astype(np.uint32)
    return (out + index["low"][:, None]).reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    index, payload, places, values = pack_blocks(flat)
    return b"".join([
        _HEAD.pack(b"TGPF", len(doc_ids), len(flat), len(index), len(payload), len(places)),
        np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(x) for x in ids], np.uint32).tobytes(), index.tobytes(), payload, places, values])


def read_segments(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, null marks, ids of each document, all ids) of each segment of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, blocks, size, extra = _HEAD.unpack_from(content, at)
        if magic != b"TGPF":
            raise ValueError("not a token-id segment")
        at += _HEAD.size
        parts = []
        for kind, count in ((np.int64, docs), (np.uint8, docs), (np.uint32, docs), (_INDEX, blocks), (np.uint8, size), (np.uint8, extra), (np.uint32, extra)):
            parts.append(np.frombuffer(content, kind, count, at))
            at += parts[-1].nbytes
        at += 1
        yield parts[0], parts[1], parts[2], unpack_blocks(*parts[3:], n)


def read_block(content: bytes, block: int) -> np.ndarray:
    """One block of a file's first segment, read through the index alone."""
    _, docs, n, blocks, size, extra = _HEAD.unpack_from(content, 0)
    at = _HEAD.size + docs * 13
    index = np.frombuffer(content, _INDEX, blocks, at)
    at += index.nbytes
    one, before = index[block:block + 1], int(index["extra"][:block].sum())
    own = int(one["extra"][0])
    payload = np.frombuffer(content, np.uint8, int(one["width"][0]) * BLOCK // 8, at + int(one["start"][0]))
    places = np.frombuffer(content, np.uint8, own, at + size + before)
    values = np.frombuffer(content, np.uint32, own, at + size + extra + 4 * before)
    return unpack_blocks(one, payload, places, values, min(BLOCK, n - block * BLOCK))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id",
                      text: str = "text", partitions: int | None = None) -> None:
    """Encode texts, append end_id to each, and write part files in ascending doc_id order.

    Rows are dealt by ranges of doc_id, and the part number follows the range, so reading the parts in
    the order of their numbers gives all documents in order. There are as many ranges as keep a part's texts
    near PART_BYTES, so a part can be read back whole; rows of one doc_id, or of none, spread over ranges by
    the order they were read in.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(tokenizer_path)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), document_ids(table, batch.column(1), end_id), strict=True):
                if held and size + len(ids) > SEGMENT_IDS:
                    yield pa.record_batch([pa.array([write_segment(names, held)], pa.binary())], ["value"])
                    names, held, size = [], [], 0
                names.append(name)
                held.append(ids.astype(np.uint16) if len(ids) and int(ids.max()) < 1 << 16 else ids)
                size += len(ids)
        if held:
            yield pa.record_batch([pa.array([write_segment(names, held)], pa.binary())], ["value"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    if partitions is None:
        in_all = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
        least = -(-in_all // PART_BYTES)
        partitions = least if least > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    number = [] if partitions is None else [partitions]
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = narrow.repartitionByRange(*number, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # Spark's text writer stores the bytes as they are, on any file system that Spark knows.
    dealt.mapInArrow(segments, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian binary) of every document."""
    files = spark.read.format("binaryFile").load(path).withColumn(
        "part", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.record_batch([pa.array([part]), pa.array([_ids_in(content.as_py())])], ["part", "ids_in"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for names, null, lengths, ids in read_segments(content.as_py()):
                    ends = np.cumsum(lengths.astype(np.int64))
                    starts = ends - lengths
                    yield pa.record_batch([
                        pa.array(np.full(len(names), part)), pa.array(names, mask=null.astype(bool)), pa.array(before + starts),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                        ["part", "doc_id", "start", "n_tokens", "ids"])
                    before += len(ids)

    bytes_of = files.select("part", "content")
    sizes = bytes_of.mapInArrow(totals, "part long, ids_in long").groupBy("part").agg(F.sum("ids_in").alias("ids_in"))
    # one short row per file: small enough to broadcast at any number of documents
    begins = sizes.select("part", (F.sum("ids_in").over(Window.orderBy("part")) - F.col("ids_in")).alias("begin"))
    rows = bytes_of.mapInArrow(documents, "part long, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(begins), "part").select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids")


def _ids_in(content: bytes) -> int:
    """Ids in a file, from the headers alone."""
    total = at = 0
    while at < len(content):
        _, docs, n, blocks, size, extra = _HEAD.unpack_from(content, at)
        total += n
        at += _HEAD.size + docs * 13 + blocks * _INDEX.itemsize + size + extra * 5 + 1
    return total


