"""Token ids of whole texts, encoding each distinct piece of text once per worker.

A text is cut where the tokenizer's own pre-tokenisation always cuts: at ASCII white space, between a
letter (ASCII, or U+00C0 to U+00FF), an ASCII digit and plain ASCII punctuation, and between ASCII
digits. No cut touches any other byte, an apostrophe, a control character or one of < | >, so
contractions, combining marks, other white space and the tokenizer's special strings stay inside one
piece. Encoding the pieces one by one therefore gives the ids of the whole text. Pieces of one plain
kind are single words of the tokenizer, already normalised, and go straight to its model.

Pieces are recognised by a 64-bit hash of their bytes (A-Z folded when no special string can occur).
The table of known pieces is bounded: it is emptied when it holds TABLE_PIECES pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from tradeglass.llm.words import LOWER, SPACE, _marks, chunks, ranges, span_hashes

TABLE_PIECES = 300_000
PIECE_CHUNK = 1 << 20

_LETTER, _PUNCT, _FREE, _DIGIT = 1, 2, 3, 4
_KIND = np.full(256, _FREE, np.uint8)
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = _PUNCT
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KIND[[c for c in range(128) if chr(c).isdigit()]] = _DIGIT
_KIND[SPACE] = 0


#: Byte values as characters in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


def byte_chars(text: str) -> str:
    """The UTF-8 bytes of a text in the alphabet of byte-level vocabularies."""
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(BYTE_CHARS)


def _kinds(data: np.ndarray) -> np.ndarray:
    """Class of every byte; both bytes of a letter U+00C0 to U+00FF count as a letter."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = _LETTER
        kind[lead + 1] = _LETTER
    return kind


def _folded(data: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        upper = lead[(data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)] + 1
        low[upper] += 0x20
    return low


class PieceTable:
    """Ids of pieces.

    encode_words takes lower-case pieces of one plain kind, encode_pieces any others; both return id lists.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]],
                 encode_pieces: Callable[[list[str]], list[list[int]]], limit: int = TABLE_PIECES):
        self.encode_words, self.encode_pieces, self.limit = encode_words, encode_pieces, limit
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, keys: list[int], texts: list[str], plain: np.ndarray) -> np.ndarray:
        """Encode new pieces and give their table rows."""
        found: list[list[int]] = [[]] * len(keys)
        for mask, encode in ((plain, self.encode_words), (~plain, self.encode_pieces)):
            picked = np.flatnonzero(mask).tolist()
            for i, ids in zip(picked, encode([texts[i] for i in picked]), strict=True):
                found[i] = ids
        row, lengths = len(self.rows), np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(lengths.sum()))
        while row + len(keys) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts] * 2), np.concatenate([self.lengths] * 2)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.starts[row:row + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[row:row + len(keys)] = lengths
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.rows.update(zip(keys, range(row, row + len(keys)), strict=True))
        return np.arange(row, row + len(keys))

    def _lookup(self, raw: np.ndarray, folded: bool, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table rows of the pieces of a chunk."""
        hashes = span_hashes(raw, kind != 0, starts, ends)
        codes, distinct = pd.factorize(hashes)
        if len(self.rows) + len(distinct) > self.limit:
            self._clear()
        known = distinct.tolist()
        get = self.rows.get
        rows = np.array([get(h, -1) for h in known], np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[missing]
            whole = raw.tobytes()
            free = np.zeros(len(kind) + 1, np.int32)
            np.cumsum(kind == _FREE, out=free[1:])
            texts = [whole[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            plain = (free[ends[at]] == free[starts[at]]) & folded
            rows[missing] = self._add([known[i] for i in missing.tolist()], texts, plain)
        return rows[codes]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of documents, their offsets) until all rows are given."""
        for first, data, offsets in chunks(texts, PIECE_CHUNK):
            kind = _kinds(data)
            cut = np.zeros(len(kind), bool)
            before, here = kind[:-1], kind[1:]
            cut[1:] = ((before != here) | (here == _DIGIT)) & (before != _FREE) & (here != _FREE)
            starts, ends = _marks(kind != 0, offsets, cut)
            bounds = np.searchsorted(starts, offsets)
            if not len(starts):
                yield first, np.zeros(0, np.uint32), bounds
                continue
            folded = b"<|" not in data.tobytes()
            rows = self._lookup(_folded(data) if folded else data, folded, kind, starts, ends)
            lengths = self.lengths[rows]
            ids = self.flat[ranges(self.starts[rows], lengths)]
            yield first, ids, np.concatenate([[0], np.cumsum(lengths)])[bounds]


_tables: dict[str, PieceTable] = {}


def library_table(tokenizer_path: str) -> PieceTable:
    """The worker's table for a tokenizers-library file, encoding without added special tokens."""
    if tokenizer_path not in _tables:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        words = tokenizer.model.tokenize
        _tables[tokenizer_path] = PieceTable(
            lambda texts: [[t.id for t in words(byte_chars(x))] for x in texts],
            lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    return _tables[tokenizer_path]


def document_ids(table: PieceTable, texts: pa.Array, end_id: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each document in turn, with end_id appended when given."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    for _, ids, bounds in table.encode(texts):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.concatenate([ids[a:b], tail]) if len(tail) else ids[a:b]
