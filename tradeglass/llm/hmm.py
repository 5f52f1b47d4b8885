"""Hidden Markov language model over words.

Words are counted over all training texts. The KNOWN most frequent words have a number; the VOCABULARY most
frequent of them are symbols of the model, beside two more: `other`, for every other word, and the end of
a text. STATES latent states are trained by Baum-Welch: each partition runs the scaled forward and
backward recursions over its training texts and adds up expected counts, Spark sums them by symbol, and
ROUNDS rounds follow one another. Only such sums, whose size is fixed, reach the driver.

The probability of a text is that of its symbols, by the scaled forward recursion over the whole text,
times the probability of each other word within `other`: (count - D) / total, with D from the numbers of words
seen once and twice; what D takes away is the probability of an unseen word. Counts of words without a
number come by a join on the word's hash, so no table that grows with the corpus is broadcast.

Odd inputs: null, empty and blank texts are the end token alone; a row without doc_id is not learned from
and counts as held out; repeated rows are learned from and scored one by one; with nothing to learn from,
every token is unseen; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeglass.llm.words import ranges, words_of
from tradeglass.session import stored

KNOWN, VOCABULARY, STATES, ROUNDS, PRIOR = 65_000, 32_768, 8, 5, 20.0
COLD = 65_535
OTHER, END = VOCABULARY, VOCABULARY + 1
TOKENS_AT_ONCE = 1_500_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of texts, folded per run of about a million words."""
    held: list[np.ndarray] = []

    def folded() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for _, words, _ in words_of(batch.column(0)):
            held.append(words)
            if sum(map(len, held)) > 2_000_000:
                yield folded()
                held = []
    if held:
        yield folded()


@dataclass
class Counts:
    """Corpus counts: numbered words in falling order of frequency, and totals over all tokens."""

    words: np.ndarray
    seen: np.ndarray
    texts: int
    total: int
    distinct: int
    once: int
    twice: int

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the add-0.1 unigram probability of tokens seen n times."""
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    @property
    def discount(self) -> float:
        return min(0.9, max(0.1, self.once / max(1, self.once + 2 * self.twice)))

    @property
    def other_total(self) -> int:
        return self.total - self.texts - int(self.seen[:VOCABULARY].sum())

    @property
    def other_words(self) -> int:
        return max(0, self.distinct - 1 - min(VOCABULARY, len(self.words)))

    def within(self, n: np.ndarray) -> np.ndarray:
        """log10 probability, within `other`, of its words seen n times."""
        total, kinds = self.other_total, self.other_words
        if not kinds:
            return np.zeros(len(n))
        return np.log10(np.where(n > 0, n - self.discount, self.discount * kinds) / total)


def count_words(train: DataFrame) -> tuple[DataFrame, Counts]:
    """(word, n) of every training word, and the bounded part of it that all tasks get."""
    texts = train.select("text")
    counts = stored(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    by_n = counts.groupBy("n").agg(F.count("*").alias("kinds"))
    more = F.sum("kinds").over(Window.orderBy(F.desc("n")))
    least = by_n.select("n", more.alias("kinds")).where(F.col("kinds") <= KNOWN).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= least).collect() if least is not None else []  # KNOWN rows at most
    top.sort(key=lambda r: (-r.n, r.word))
    sums = counts.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    n_texts = texts.count()
    return counts, Counts(np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64), n_texts,
                          (sums[0] or 0) + n_texts, sums[1] + bool(n_texts), sums[2], sums[3])


def _numbered(known):
    """(row, doc_id, held_out, symbols, cold): the number of each word, and the hashes of words without one."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value.words
        order = np.argsort(words)
        ordered = words[order]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, found, bounds in words_of(batch.column(2)):
                at = np.minimum(np.searchsorted(ordered, found), max(0, len(ordered) - 1))
                hit = ordered[at] == found if len(ordered) else np.zeros(len(found), bool)
                numbers = np.where(hit, order[at], COLD).astype(np.uint16) if len(ordered) else np.full(len(found), COLD, np.uint16)
                cold = found[~hit]
                cold_bounds = np.concatenate([[0], np.cumsum(~hit)])[bounds]
                n = len(bounds) - 1
                yield pa.record_batch([
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                    pa.array([numbers[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    pa.array([cold[a:b].tobytes() for a, b in zip(cold_bounds[:-1], cold_bounds[1:], strict=True)], pa.binary())],
                    ["row", "doc_id", "held_out", "numbers", "cold"])
                row += n
    return rows


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def begin(symbol_counts: np.ndarray) -> Hmm:
        """Sticky states whose emissions are the corpus frequencies with fixed random weights."""
        rng = np.random.default_rng(11)
        emit = _prior(symbol_counts)[:, None] * np.exp(0.5 * rng.standard_normal((END + 1, STATES)))
        move = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(move, 0.95)
        return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, symbol_counts: np.ndarray) -> Hmm:
        start, move = start + 1e-3, move + 1e-3
        emit = emit + PRIOR * _prior(symbol_counts)[:, None]
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _prior(symbol_counts: np.ndarray) -> np.ndarray:
    smooth = symbol_counts + 0.1
    return smooth / smooth.sum()


def symbols_of(numbers: np.ndarray) -> np.ndarray:
    return np.minimum(numbers.astype(np.int32), OTHER)


class Sweep:
    """Texts of a batch laid out so that each step handles all texts that are still running."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts], np.int64) + 1
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.steps = int(self.lengths[0])
        self.running = len(texts) - np.searchsorted(self.lengths[::-1], np.arange(self.steps), "right")
        begin = np.concatenate([[0], np.cumsum(self.running)])
        self.begin = begin
        self.symbols = np.empty(int(begin[-1]), np.int32)
        flat = np.concatenate([np.concatenate([texts[i], [END]]) for i in self.order.tolist()])
        step = ranges(np.zeros(len(texts), np.int64), self.lengths)
        rank = np.repeat(np.arange(len(texts)), self.lengths)
        self.symbols[begin[step] + rank] = flat

    def forward(self, model: Hmm, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(natural log likelihood of each text in the original order, scales of every step)."""
        total = np.zeros(len(self.order))
        scales = np.empty(len(self.symbols)) if keep is not None else None
        state = None
        for t in range(self.steps):
            a, b = self.begin[t], self.begin[t + 1]
            ahead = np.broadcast_to(model.start, (b - a, STATES)) if state is None else state[:b - a] @ model.move
            state = ahead * model.emit[self.symbols[a:b]]
            scale = state.sum(1)
            state = state / scale[:, None]
            total[:b - a] += np.log(scale)
            if keep is not None:
                keep[a:b], scales[a:b] = state, scale
        out = np.empty(len(total))
        out[self.order] = total
        return out, scales

    def expected(self, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected start, transition and emission counts of the batch, and its log likelihood."""
        alpha = np.empty((len(self.symbols), STATES), np.float32)
        likelihood, scales = self.forward(model, alpha)
        move = np.zeros((STATES, STATES))
        after = np.ones((0, STATES))
        for t in range(self.steps - 1, -1, -1):
            a, b = self.begin[t], self.begin[t + 1]
            beta = np.ones((b - a, STATES))
            if len(after):
                beta[:len(after)] = after @ model.move.T
                move += alpha[a:a + len(after)].T.astype(np.float64) @ after
            own = model.emit[self.symbols[a:b]] / scales[a:b, None] * beta
            alpha[a:b] *= beta
            after = own
        start = alpha[:self.begin[1]].sum(0, dtype=np.float64)
        emit = np.stack([np.bincount(self.symbols, alpha[:, k], END + 1) for k in range(STATES)], axis=1)
        return start, move * model.move, emit, likelihood


def _batches_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """Runs of rows of about TOKENS_AT_ONCE words, with the numbers of their words."""
    held: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        begin = 0
        for i, raw in enumerate(batch.column(column)):
            texts.append(np.frombuffer(raw.as_buffer(), np.uint16))
            size += len(texts[-1]) + 1
            if size > TOKENS_AT_ONCE:
                held.append(batch.slice(begin, i + 1 - begin))
                yield texts, pa.Table.from_batches(held)
                held, texts, size, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if texts:
        yield texts, pa.Table.from_batches(held)


def _expected(model):
    """Rows (symbol, one sum per state); start and transition counts follow the symbols."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((END + 2 + STATES, STATES))
        for texts, _ in _batches_of(batches, "numbers"):
            start, move, emit, _ = Sweep([symbols_of(t) for t in texts]).expected(model.value)
            found[:END + 1] += emit
            found[END + 1] += start
            found[END + 2:] += move
        used = np.flatnonzero(found.any(1))
        if len(used):
            yield pa.record_batch([pa.array(used), *[pa.array(found[used, k]) for k in range(STATES)]], ["symbol", *[f"c{k}" for k in range(STATES)]])
    return sums


def train(numbered: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over every row that is not held out."""
    context = numbered.sparkSession.sparkContext
    symbol_counts = np.zeros(END + 1)
    symbol_counts[:min(VOCABULARY, len(counts.seen))] = counts.seen[:VOCABULARY]
    symbol_counts[OTHER], symbol_counts[END] = counts.other_total, counts.texts
    model = Hmm.begin(symbol_counts)
    texts = numbered.where("NOT held_out").select("numbers")
    names = [f"c{k}" for k in range(STATES)]
    for _ in range(rounds):
        sums = texts.mapInArrow(_expected(context.broadcast(model)), "symbol long, " + ", ".join(f"{n} double" for n in names))
        rows = sums.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # symbols and states only
        found = np.zeros((END + 2 + STATES, STATES))
        found[rows["symbol"].to_numpy(np.int64)] = rows[names].to_numpy()
        model = Hmm.from_counts(found[END + 1], found[END + 2:], found[:END + 1], symbol_counts)
    return model


def _scored(model, known):
    """Scores of the part of each text that needs no join."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts = known.value
        seen = np.zeros(COLD + 1, np.int64)
        seen[:len(counts.seen)] = counts.seen
        base = counts.base(seen)
        within = counts.within(seen)
        within[:VOCABULARY] = 0
        base[COLD] = within[COLD] = 0
        known_word = seen > 0
        end = float(counts.base(np.array([counts.texts]))[0])
        for texts, table in _batches_of(batches, "numbers"):
            likelihood, _ = Sweep([symbols_of(t) for t in texts]).forward(model.value)
            lengths = np.array([len(t) for t in texts], np.int64)
            text = np.repeat(np.arange(len(texts)), lengths)
            flat = np.concatenate(texts)
            sums = [np.bincount(text, w[flat], len(texts)) for w in (base, within, known_word)]
            yield pa.record_batch([
                table.column("row").combine_chunks(), table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(),
                pa.array(lengths + 1), pa.array(sums[2].astype(np.int64) + (1 if counts.texts else 0)), pa.array(sums[0] + end),
                pa.array(likelihood / np.log(10) + sums[1])], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return rows


def _cold_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cold = [np.frombuffer(c.as_buffer(), np.int64) for c in batch.column(1)]
        rows = np.repeat(batch.column(0).to_numpy(), [len(c) for c in cold])
        flat = np.concatenate(cold) if cold else np.zeros(0, np.int64)
        for at in range(0, len(flat), 500_000):
            yield pa.record_batch([pa.array(rows[at:at + 500_000]), pa.array(flat[at:at + 500_000])], ["row", "word"])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    context = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    word_counts, counts = count_words(narrow.where("NOT held_out"))
    known = context.broadcast(counts)
    numbered = stored(narrow.mapInArrow(_numbered(known), "row long, doc_id long, held_out boolean, numbers binary, cold binary"), "numbered")
    model = context.broadcast(train(numbered, counts))
    scored = numbered.select("row", "doc_id", "held_out", "numbers").mapInArrow(
        _scored(model, known), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    cold = numbered.select("row", "cold").mapInArrow(_cold_words, "row long, word long")
    n = F.coalesce("n", F.lit(0))
    size = counts.total + 0.1 * (counts.distinct + 1)
    base = F.log10((n + 0.1) / F.lit(float(size)))
    if counts.other_words:
        within = F.log10(F.when(n > 0, n - F.lit(counts.discount)).otherwise(counts.discount * counts.other_words) / float(counts.other_total))
    else:
        within = F.lit(0.0)
    rest = cold.join(word_counts, "word", "left").groupBy("row").agg(
        F.sum(base).alias("cold_base"), F.sum(within).alias("cold_within"), F.count("n").alias("cold_known"))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("cold_within", F.lit(0.0))).alias("score"))
