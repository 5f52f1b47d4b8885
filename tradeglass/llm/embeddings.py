"""Near-duplicate embeddings: randomly rotated binary codes, estimates with bounds, exact checks.

A unit vector is rotated by random orthogonal matrices; the signs are its code. Beside the code stands the
correction factor f = <code / sqrt(d), rotated vector>. For two unit vectors o and q,
<code of o / sqrt(d), rotated q> / f estimates <o, q> without bias. Its error is at most
ERRORS * sqrt((1 - f^2) / f^2 / (d - 1)) * sqrt(1 - <o, q>^2), up to about 1e-6. A pair whose estimate plus that
bound stays under the threshold is passed over; every other pair is computed again in double precision.

Pairs meet in tables keyed by code bits, under the same label. A label of n vectors has about log2(n / BLOCK) bits
a table (BITS at least, MOST_BITS at most), so a bucket stays near a block however large the label, and as
many tables as keep the probability that a pair at the threshold misses all of them at MISSED (20 tables of
10 bits, 63 of 24, at cosine 0.98). Every table takes bits of its own. Buckets of any size are cut
into cells of two blocks, and a pair counts in the first of its tables only. Equal vectors of a label
are one node with a weight, so copies cost nothing.

Odd inputs: a vector that is null, zero, empty or holds a null or non-finite component, and a row without
label or vec_id, links with nothing and is its own component; equal rows count as different vectors, and
rows that repeat a vec_id share its component; vectors of different lengths never link; an empty table
gives no rows. A row without vec_id has no component and is not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeglass.llm.components import cells, connected
from tradeglass.llm.grouped import by_cell, emit, roots
from tradeglass.session import stored

BITS, MOST_BITS, MISSED, BLOCK, ERRORS = 10, 24, 5e-7, 512, 5.0


def tables_of(bits: int, threshold: float) -> int:
    """Fewest tables of so many bits that miss a pair at the threshold with probability MISSED at most."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if same >= 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - same)))


def rotations(d: int, bits: int) -> np.ndarray:
    """Enough random orthogonal d x d matrices, one above the other, for so many bits."""
    rng = np.random.default_rng(d)
    made = []
    while sum(map(len, made)) < max(bits, d):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe from overflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(units: np.ndarray, bits: int = BITS, threshold: float = 0.98) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs +-1 of the first rotation, correction factors, table keys) of unit vectors."""
    d, tables = units.shape[1], tables_of(bits, threshold)
    rotated = units @ rotations(d, bits * tables).T
    signs = np.where(rotated[:, :d] >= 0, 1.0, -1.0)
    factor = (signs * rotated[:, :d]).sum(1) / np.sqrt(d)
    own = (rotated[:, :bits * tables] >= 0).reshape(len(units), tables, bits)
    return signs, factor, own @ (1 << np.arange(bits))


_CODED = pa.schema([("node", pa.int64()), ("label", pa.string()), ("weight", pa.int64()), ("d", pa.int32()), ("vector", pa.binary()),
                    ("code", pa.binary()), ("factor", pa.float64()), ("keys", pa.list_(pa.int32()))])
_CODED_DDL = "node long, label string, weight long, d int, vector binary, code binary, factor double, keys array<int>"


def _coded(threshold: float):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector")
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts, bits = np.cumsum(sizes) - sizes, batch.column("bits").to_numpy()
            for d, b in np.unique(np.stack([sizes, bits]), axis=1).T.tolist():
                alike = np.flatnonzero((sizes == d) & (bits == b))
                for at in np.array_split(alike, max(1, len(alike) // 4096)):
                    x = flat[starts[at][:, None] + np.arange(d)]
                    signs, factor, keys = encode(unit(x), b, threshold)
                    own = batch.take(pa.array(at))
                    yield emit(_CODED, own.column("node"), own.column("label"), own.column("weight"), np.full(len(at), d, np.int32), [r.tobytes() for r in x],
                               [r.tobytes() for r in np.packbits(signs > 0, axis=1)], factor, keys.astype(np.int32).tolist())
    return coded


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _linked(threshold: float):
    """Links of every node within its cell, and the smallest node it reaches there."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in by_cell(batches, "cell"):
            columns = {c: table.column(c).to_numpy() for c in ("node", "weight", "d", "factor", "mine", "low", "high", "place")}
            vectors, codes, keys = (table.column(c).to_pylist() for c in ("vector", "code", "keys"))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = {c: x[a:b] for c, x in columns.items()}
                left = np.flatnonzero(own["mine"] == own["low"])
                right = left if own["low"][0] == own["high"][0] else np.flatnonzero(own["mine"] == own["high"])
                if not len(left) or not len(right) or b - a < 2:
                    continue
                d = int(own["d"][0])
                units = unit(np.frombuffer(b"".join(vectors[a:b]), np.float64).reshape(-1, d))
                signs = np.unpackbits(np.frombuffer(b"".join(codes[a:b]), np.uint8).reshape(b - a, -1), axis=1)[:, :d] * 2.0 - 1.0
                u, v = _pairs(left, right, units, signs, own["factor"], threshold)
                table_keys = np.array(keys[a:b], np.int32)
                first = (table_keys[u] == table_keys[v]).argmax(1) == own["place"][0]
                u, v = u[first], v[first]
                if not len(u):
                    continue
                count = np.zeros(b - a, np.int64)
                np.add.at(count, u, own["weight"][v])
                np.add.at(count, v, own["weight"][u])
                order = np.argsort(own["node"], kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                root = own["node"][order][roots(back[u], back[v], b - a)[back]]
                at = np.flatnonzero(count)
                yield emit(_FOUND, own["node"][at], count[at], root[at])
    return links


def _pairs(left: np.ndarray, right: np.ndarray, units: np.ndarray, signs: np.ndarray, factor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the threshold or above: estimates choose, exact products decide."""
    d = units.shape[1]
    if d > 1:
        # a common rotation of signs and vectors changes no product, so the code is turned back instead of the vectors
        turned = signs[left] @ rotations(d, d)[:d]
        estimate = turned @ units[right].T / (np.sqrt(d) * factor[left][:, None])
        f = factor[left]
        slack = ERRORS * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / (d - 1)) * np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
        i, j = np.nonzero(estimate + slack[:, None] >= threshold)
    else:
        i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    u, v = left[i], right[j]
    if left is right:
        u, v = u[u < v], v[u < v]
    exact = np.concatenate([(units[u[k:k + 65536]] * units[v[k:k + 65536]]).sum(1) for k in range(0, len(u), 65536)] or [np.zeros(0)])
    return u[exact >= threshold], v[exact >= threshold]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links join rows of one label at the threshold or above."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("key", F.when(sound, F.sha2(F.concat_ws(",", F.col("label"), F.transform("vector", lambda x: F.hex(x.cast("string")))), 256)))
    alike = marked.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.first("label").alias("label"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    nodes = stored(alike, "vectors")
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(BITS), F.ceil(F.log2(F.count("*") / BLOCK))))
    sizes = stored(nodes.groupBy("label").agg(bits.cast("int").alias("bits")), "label-bits")
    sized = nodes.join(sizes, "label").select("node", "label", "weight", "vector", "bits")
    coded = stored(sized.mapInArrow(_coded(threshold), _CODED_DDL), "codes")
    tables = coded.select("*", F.posexplode("keys").alias("place", "bits"))
    narrow = tables.select("label", "d", "place", "bits", "node")
    dealt = cells(narrow, ["label", "d", "place", "bits"], "node", BLOCK).drop("label", "d", "bits").join(coded, "node")
    found = stored(dealt.repartition("cell").sortWithinPartitions("cell").select(
        "cell", "mine", "low", "high", "place", "node", "weight", "d", "vector", "code", "factor", "keys").mapInArrow(_linked(threshold), "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected(found.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v"))
    by_node = (nodes.select("key", "node", "weight").join(counts, "node", "left")
               .join(labels.withColumnRenamed("label", "component"), "node", "left")
               .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = marked.select("vec_id", "key").join(by_node, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
