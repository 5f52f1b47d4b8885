"""Language of texts by a string kernel.

The blended-spectrum kernel of two texts is the number of n-grams (bytes, n = 1 to 3, letters folded) that
both hold, over the root of the product of their own numbers. N-grams are hashed to FEATURES places.
LANDMARKS texts span a Nystroem feature space, in which one-versus-rest kernel ridge regression is
solved. Scoring a batch is two matrix products: presence rows with landmark rows, kernel rows with the
solved weights.

Only the fit uses a sample, SAMPLE rows at most, shared evenly among the languages (LANGUAGE_ROWS of one at
most) and chosen by a hash of doc_id: every other row, whatever its size, is only scored. A share of each
language that holds SPARE times what is picked is cut out by that hash first, so the window of a language
never reads more than that. A prediction sees the text alone.

Odd inputs: a null text, or one without any letter, gets `und` with score 0; so does every text when no
row has a language to learn from. Such texts and rows without doc_id are not learned from. Repeated rows, ties and
extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeglass.llm.pieces import _folded
from tradeglass.llm.words import chunks

FEATURES, LANDMARKS, SAMPLE, LANGUAGE_ROWS, RIDGE, ROWS_AT_ONCE = 1 << 14, 128, 4096, 1000, 1e-3, 64
#: Rows of a language that are looked at for each one picked.
SPARE = 4
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def presence(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, one row of 0.0 and 1.0 per text) for runs of texts."""
    for first, data, offsets in chunks(texts):
        low = _folded(data).astype(np.uint32)
        for a in range(0, len(offsets) - 1, ROWS_AT_ONCE):
            rows = min(ROWS_AT_ONCE, len(offsets) - 1 - a)
            out = np.zeros(rows * FEATURES, np.float32)
            begin, end = int(offsets[a]), int(offsets[a + rows])
            part = low[begin:end]
            row = np.repeat(np.arange(rows), np.diff(offsets[a:a + rows + 1]))
            code = np.zeros(len(part), np.uint32)
            for n in (1, 2, 3):
                grams = len(part) - n + 1
                if grams <= 0:
                    break
                code = code[:grams] * np.uint32(257) + part[n - 1:] + np.uint32(1)
                whole = row[:grams] == row[n - 1:]
                place = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 14)
                out[(row[:grams] * FEATURES + place)[whole]] = 1
            yield first + a, out.reshape(rows, FEATURES)


@dataclass
class Model:
    """Languages, packed landmark rows and the weights from kernel values to language scores."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(1, rows.sum(1)))[:, None] * np.sqrt(np.maximum(1, marks.sum(1)))[None, :]
        kernel = rows @ marks.T / sizes
        return np.concatenate([kernel, np.ones((len(kernel), 1), np.float32)], axis=1) @ self.weights


def solve(bits: np.ndarray, names: list[str]) -> Model:
    """A model from packed presence rows in the order of the sample; landmarks are taken in turn from the languages."""
    languages = sorted(set(names))
    kind = np.array([languages.index(x) for x in names])
    turn = np.zeros(len(kind), np.int64)
    for k in range(len(languages)):
        turn[kind == k] = np.arange((kind == k).sum())
    chosen = np.lexsort((kind, turn))[:LANDMARKS]
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    own = np.sqrt(np.maximum(1, marks.sum(1)))
    kernel = (marks @ marks.T / own[:, None] / own[None, :]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values[-1]
    to_space = vectors[:, keep] / np.sqrt(values[keep])
    parts = []
    for at in range(0, len(bits), 256):
        rows = np.unpackbits(bits[at:at + 256], axis=1).astype(np.float32)
        parts.append(rows @ marks.T / np.sqrt(np.maximum(1, rows.sum(1)))[:, None] / own[None, :])
    space = np.concatenate([np.concatenate(parts) @ to_space, np.ones((len(bits), 1))], axis=1)
    target = np.where(kind[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = 1 / np.bincount(kind, minlength=len(languages))[kind]  # every language weighs the same
    gram = (space * share[:, None]).T @ space + RIDGE * np.diag([1.0] * (space.shape[1] - 1) + [0.0]) + 1e-9 * np.eye(space.shape[1])
    ridge = np.linalg.solve(gram, (space * share[:, None]).T @ target)
    weights = np.concatenate([to_space @ ridge[:-1], ridge[-1:]])
    return Model(languages, bits[chosen], weights.astype(np.float32))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from a bounded sample of the rows with text and language; None where there are none."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    named = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # one number per language of the model
    if not counts:
        return None
    most = max(1, min(LANGUAGE_ROWS, SAMPLE // len(counts)))
    # rows are picked by a hash of their id; those that cannot be among the first are left out before any row is shuffled
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, SPARE * most / n)))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    near = named.select("doc_id", "lang", chance.alias("chance")).where(F.col("chance") < F.element_at(shares, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("chance", "doc_id")
    picked = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("chance")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, out in presence(batch.column(0)):
                yield pa.record_batch([pa.array([r.tobytes() for r in np.packbits(out > 0, axis=1)], pa.binary()),
                                       batch.column(1).slice(first, len(out)), batch.column(2).slice(first, len(out))], ["bits", "lang", "place"])

    # at most SAMPLE short rows (and one for each language beyond) are sent out, and as many bit rows come back
    sample = named.join(F.broadcast(picked), ["doc_id", "lang"]).select("text", "lang", "place").mapInArrow(rows_of, "bits binary, lang string, place int")
    got = sorted(sample.collect(), key=lambda r: (r.place, r.lang, bytes(r.bits)))
    return solve(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), [r.lang for r in got])


def predict(text: Column, model: Model | None) -> Column:
    """Struct of lang_pred and score (0 to 1) for a text column."""
    def languages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32) if model else None
        for batch in batches:
            names, scores = [], []
            for first, rows in presence(batch):
                found = model.scores(rows, marks) if model else np.zeros((len(rows), 1), np.float32)
                best = found.argmax(1)
                sure = 1 / np.exp(4 * (found - found.max(1, keepdims=True))).sum(1)
                for i, t in enumerate(batch.slice(first, len(rows)).to_pylist()):
                    known = model is not None and t is not None and _LETTER.search(t) is not None
                    names.append(model.languages[best[i]] if known else UNKNOWN)
                    scores.append(float(sure[i]) if known else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    languages.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(languages, "lang_pred string, score double")(text)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for null."""
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t is not None and _LETTER.search(t) is not None for t in batch.to_pylist()], pa.bool_())

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(found, "boolean")(text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; held-out rows are not learned from."""
    model = fit(docs.where(~held_out(doc_id)), doc_id, text, lang)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), predict(F.col(text).cast("string"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
