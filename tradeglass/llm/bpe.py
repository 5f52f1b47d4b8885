"""Byte-pair encoding and decoding with a given vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the ranks of the pairs that stand
side by side. The best-ranked, leftmost pair is merged, its neighbours enter the queue, and entries
whose symbols have changed since they were queued are skipped when they come up. Decoding joins the
vocabulary strings with single spaces, as a file without a decoder asks for.

Results for odd inputs: a null or empty text has no ids and decodes to the empty text; null ids count
as none. Every row gives its own result, so repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeglass.llm.pieces import PieceTable, byte_chars, document_ids

#: Pre-tokenisation pattern of the vocabulary file (a fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_WHITE = regex.compile(r"\p{White_Space}+")
WORD_END = "</w>"
ROWS_OUT = 256


class Bpe:
    """Vocabulary, merge ranks and added tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        strings = self.vocab | self.added
        self.strings = [""] * (max(strings.values()) + 1)
        for text, token in strings.items():
            self.strings[token] = text
        added = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(added) + ")") if added else None

    def word(self, chars: str) -> list[int]:
        """Ids of one word given in the byte alphabet."""
        marks = [*chars[:-1], chars[-1] + WORD_END]
        symbols = [self.vocab[m] for m in marks if m in self.vocab]
        n = len(symbols)
        if n < 2:
            return symbols
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def enter(at: int) -> None:
            other = right[at]
            if at >= 0 and other >= 0 and (merge := self.merges.get((symbols[at], symbols[other]))):
                heapq.heappush(queue, (merge[0], at, symbols[at], symbols[other], merge[1]))

        for i in range(n - 1):
            enter(i)
        while queue:
            _, at, first, second, merged = heapq.heappop(queue)
            other = right[at]
            if symbols[at] != first or other < 0 or symbols[other] != second:
                continue
            symbols[at], symbols[other] = merged, -1
            right[at] = right[other]
            if right[at] >= 0:
                left[right[at]] = at
            enter(at)
            if left[at] >= 0:
                enter(left[at])
        return [s for s in symbols if s >= 0]

    def text(self, text: str) -> list[int]:
        """Ids of any text: added tokens, then normalised words."""
        ids: list[int] = []
        for part in self._added.split(text) if self._added else [text]:
            if part in self.added:
                ids.append(self.added[part])
                continue
            plain = _WHITE.sub(" ", unicodedata.normalize("NFC", part))
            lower = "".join(map(str.lower, plain)) if "Σ" in plain else plain.lower()
            for word in WORDS.findall(lower):
                ids += self.word(byte_chars(word))
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.strings[i] for i in ids.tolist()])


_loaded: dict[str, tuple[Bpe, PieceTable]] = {}


def load(path: str) -> tuple[Bpe, PieceTable]:
    """The worker's vocabulary and its table of known pieces."""
    if path not in _loaded:
        bpe = Bpe(path)
        _loaded[path] = bpe, PieceTable(lambda words: [bpe.word(byte_chars(w)) for w in words],
                                        lambda texts: [bpe.text(t) for t in texts])
    return _loaded[path]


def encode(text: Column | str, path: str) -> Column:
    """Ids of a text column as little-endian unsigned 32-bit integers in one binary."""
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([x.tobytes() for x in document_ids(load(path)[1], batch)], pa.binary())

    return _arrow_iterator(ids, "binary")(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text of a column made by encode, special tokens included."""
    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in columns:
            yield pa.array([load(path)[0].decode(np.frombuffer(x or b"", np.uint32)) for x in batch.to_pylist()], pa.string())

    return _arrow_iterator(texts, "string")(ids)


def _arrow_iterator(function, kind: str):
    function.__annotations__ = {"return": Iterator[pa.Array], next(iter(function.__annotations__)): Iterator[pa.Array]}
    return F.arrow_udf(function, kind)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of docs with ids (binary) and decoded (text); those two names replace columns so called.

    Rows go out in runs of ROWS_OUT, so a worker holds the ids and texts of one run, not of a whole batch.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded") or c == text])
    at = kept.columns.index(text)
    out = [i for i, c in enumerate(kept.columns) if c not in ("ids", "decoded")]
    schema = T.StructType([kept.schema[i] for i in out]).add("ids", "binary").add("decoded", "string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = load(path)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_OUT):
                run = batch.slice(first, ROWS_OUT)
                ids, texts = [], []
                for x in document_ids(table, run.column(at)):
                    ids.append(x.tobytes())
                    texts.append(bpe.decode(x))
                yield pa.record_batch([*[run.column(i) for i in out], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(rows, schema)
