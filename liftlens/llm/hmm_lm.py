"""A hidden Markov language model over words, trained by Baum-Welch in Spark.

Symbols are the most frequent words, a fixed number of buckets for all other
words (by their last two bytes), and the end of a text. Within a bucket a word
has its smoothed share of the bucket's count, so every word, also an unseen
one, has a probability.

* Word counts cover all training texts: counted per task, summed by Spark. The
  counts of the most frequent words (``COUNTED`` at most) are broadcast; the
  rest is joined by word, so no frequent word is ever a join key.
* All training texts are written once as symbols, so that passes split no text.
* First parameters are the overall word shares, shaken apart by state with a
  fixed seed, with states that seldom move: no text is preferred to another.
* Each pass runs the scaled forward-backward recursion over all training texts;
  every task sums its expected counts and Spark adds them up.
* The scaled forward recursion gives each text's exact likelihood.

Texts of a slice run in step, so the recursions are array operations.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, drop_table, id_crc, index_words, materialize, slices, text_sums

STATES = 6
SYMBOLS = 16384
BUCKETS = 256
COUNTED = 131072
PASSES = 2
SHAKE = 0.4  # standard deviation of the logarithm of a first emission
STAY = 0.998  # first probability to stay in a state
PRIOR = 0.1
FLUSH_WORDS = 300_000
END = b" "  # no word has a space


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def held_out(id_col: str) -> Column:
    """A tenth of the documents by crc32 of the id; a null id is in training."""
    return F.coalesce(id_crc(F.col(id_col)) % 10 == 0, F.lit(False))


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c long) over all rows; each row adds one END. Tasks flush
    their counters at FLUSH_WORDS distinct words, so memory is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()), pa.array(counter.values(), pa.int64())], names=["word", "c"])
            counter.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    counter.update(words_of(text))
                counter[END] += part.num_rows
                if len(counter) > FLUSH_WORDS:
                    yield flush()
        if counter:
            yield flush()

    partial = texts.select(text_col).mapInArrow(count, "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of frequent words, symbol numbers and the buckets' totals. At most
    COUNTED words; symbols are the first ``symbols`` of them."""

    words: dict[bytes, int]  # by falling count
    counts: np.ndarray
    symbols: int
    end_count: int
    total: int  # N
    distinct: int  # V
    bucket_counts: np.ndarray
    bucket_distinct: np.ndarray

    @property
    def n_symbols(self) -> int:
        return self.symbols + BUCKETS + 1

    def weights(self) -> np.ndarray:
        """Training counts by symbol."""
        return np.concatenate([self.counts[: self.symbols], self.bucket_counts, [self.end_count]]).astype(float)

    def prior(self) -> np.ndarray:
        """Smoothing mass by symbol: PRIOR for each word type and each bucket's unseen words."""
        return PRIOR * np.concatenate([np.ones(self.symbols), self.bucket_distinct + 1.0, [1.0]])

    def number(self, words: list[bytes]) -> np.ndarray:
        """Position among the counted words, or -1."""
        get = self.words.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def observations(self, texts: list[list[bytes]]):
        """Symbols of all tokens with their ends, bounds per text, and by distinct word: number and token."""
        flat, bounds, vocab = index_words(texts)
        known = self.number(vocab)
        symbol = np.where((known >= 0) & (known < self.symbols), known, 0)
        for i in np.flatnonzero((known < 0) | (known >= self.symbols)).tolist():
            symbol[i] = self.symbols + bucket(vocab[i])
        ends = bounds[1:] + np.arange(len(texts))
        with_end = np.full(len(flat) + len(texts), self.n_symbols - 1, dtype=np.int64)
        inside = np.ones(len(with_end), dtype=bool)
        inside[ends] = False
        with_end[inside] = symbol[flat] if len(vocab) else 0
        return with_end, bounds + np.arange(len(bounds)), flat, bounds, vocab, known, symbol


def learn_vocabulary(counts: DataFrame, symbols: int = SYMBOLS, counted: int = COUNTED) -> Vocabulary:
    """From materialized token counts. The broadcast part is bounded: words are
    taken by whole count classes, from the largest, while at most ``counted``."""
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    level = F.floor(F.log2("c") * 16).cast("long")  # at most about 1000 levels
    at_least = 0
    taken = 0
    for row in sorted(counts.groupBy(level.alias("l")).count().collect(), reverse=True):
        if taken + row["count"] > counted + 1:
            at_least = row["l"] + 1
            break
        taken += row["count"]
    top = counts.filter((level >= at_least) | (F.col("word") == F.lit(END))).toArrow()
    pairs = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    end_count = dict(pairs).get(END, 0)
    pairs = [p for p in pairs if p[0] != END]
    symbols = min(symbols, len(pairs))
    rare_counts, rare_distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for w, c in pairs[symbols:]:
        rare_counts[bucket(w)] += c
        rare_distinct[bucket(w)] += 1
    rest = counts.filter((level < at_least) & (F.col("word") != F.lit(END)))
    in_bucket = F.expr(f"crc32(substring(word, -2, 2)) % {BUCKETS}").alias("b")
    for b, c, v in rest.groupBy(in_bucket).agg(F.sum("c"), F.count(F.lit(1))).collect():
        rare_counts[b] += c
        rare_distinct[b] += v
    return Vocabulary(
        {w: i for i, (w, _) in enumerate(pairs)},
        np.array([c for _, c in pairs], dtype=float),
        symbols,
        end_count,
        total or 0,
        distinct,
        rare_counts,
        rare_distinct,
    )


@dataclass
class Parameters:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # symbols x S


class InStep:
    """Texts laid out by time: all first tokens, all second tokens, ...; longer texts first."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        lengths = np.diff(bounds)
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.longest = int(ordered[0]) if len(ordered) else 0
        times = np.arange(self.longest)
        self.active = len(ordered) - np.searchsorted(ordered[::-1], times, side="right")  # texts longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        when = np.repeat(times, self.active)
        self.rank = np.arange(len(when)) - self.at[when]
        self.when = when
        self.symbols = symbols[bounds[:-1][self.order][self.rank] + when]

    def forward(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, their scales, and the emissions, per token."""
        emissions = p.emit[self.symbols]
        alpha = np.empty_like(emissions)
        scale = np.empty(len(emissions))
        at = self.at.tolist()
        before = None
        for t in range(self.longest):
            lo, hi = at[t], at[t + 1]
            now = alpha[lo:hi]
            if before is None:
                np.multiply(p.start, emissions[lo:hi], out=now)
            else:
                np.dot(before[: hi - lo], p.move, out=now)
                now *= emissions[lo:hi]
            total = now.sum(axis=1)
            scale[lo:hi] = total
            now /= total[:, None]
            before = now
        return alpha, scale, emissions

    def log_likelihood(self, p: Parameters) -> np.ndarray:
        """Natural log of each text's probability, in the texts' own order."""
        _, scale, _ = self.forward(p)
        out = np.zeros(len(self.order))
        out[self.order] = np.bincount(self.rank, weights=np.log(scale), minlength=len(self.order))
        return out

    def expected(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (Baum-Welch)."""
        alpha, scale, emissions = self.forward(p)
        beta = np.ones_like(alpha)
        emissions /= scale[:, None]  # now: emission over scale
        at = self.at.tolist()
        back = p.move.T.copy()
        for t in range(self.longest - 1, 0, -1):
            lo, hi = at[t], at[t + 1]
            now = emissions[lo:hi]
            now *= beta[lo:hi]
            np.dot(now, back, out=beta[at[t - 1] : at[t - 1] + hi - lo])
        later = np.arange(self.at[1] if self.longest else 0, len(alpha))
        earlier = self.at[self.when[later] - 1] + self.rank[later]
        moves = p.move * (alpha[earlier].T @ emissions[later])
        gamma = alpha * beta
        counts = np.column_stack(
            [np.bincount(self.symbols, weights=gamma[:, s], minlength=len(p.emit)) for s in range(gamma.shape[1])]
        )
        return gamma[: self.at[1] if self.longest else 0].sum(axis=0), moves, counts


def estimate(starts: np.ndarray, moves: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> Parameters:
    """Parameters from expected counts, smoothed by ``prior`` (mass by symbol)."""
    states = len(starts)
    emit = counts + prior[:, None] / states
    move = moves + 1.0
    start = starts + 1.0
    return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_parameters(vocab: Vocabulary, states: int) -> Parameters:
    """The word distribution, shaken apart by state with a fixed seed; states seldom move."""
    shares = vocab.weights() + vocab.prior()
    shaken = shares[:, None] * np.exp(SHAKE * np.random.default_rng(0).standard_normal((len(shares), states)))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY)
    return Parameters(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), shaken / shaken.sum(axis=0))


def encode(texts: DataFrame, vocab: Vocabulary, text_col: str = "text") -> DataFrame:
    """``symbols`` (binary): the symbols of each text with its end, in row order."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    kind = _kind(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for part in slices(batch, 0, max_bytes=2_000_000):
                symbols, bounds, *_ = vocab.observations([words_of(t) for t in part.column(0).to_pylist()])
                symbols = symbols.astype(kind)
                texts = [symbols[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["symbols"])

    return texts.select(text_col).mapInArrow(run, "symbols binary")


def _kind(vocab: Vocabulary) -> np.dtype:
    return np.dtype("<u2" if vocab.n_symbols <= 1 << 16 else "<u4")


def baum_welch(encoded: DataFrame, vocab: Vocabulary, p: Parameters) -> Parameters:
    """One pass over all ``encoded`` texts: expected counts per task, summed by Spark."""
    states = len(p.start)
    model = encoded.sparkSession.sparkContext.broadcast(p)
    kind = _kind(vocab)
    names = [f"s{i}" for i in range(states)]
    schema = pa.schema([("k", pa.int64()), *((n, pa.float64()) for n in names)])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        sums = None
        for batch in batches:
            for part in slices(batch, 0, max_bytes=300_000 * kind.itemsize):
                texts = part.column(0).to_pylist()
                bounds = np.cumsum([0, *(len(t) // kind.itemsize for t in texts)])
                got = InStep(np.frombuffer(b"".join(texts), kind).astype(np.int64), bounds).expected(p)
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
        if sums is not None:
            starts, moves, counts = sums
            seen = np.flatnonzero(counts.any(axis=1))
            rows = np.vstack([starts[None, :], moves, counts[seen]])
            keys = np.concatenate([np.arange(-1 - states, 0), seen])  # starts, moves, then symbols
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], schema=schema)

    out = T.StructType([T.StructField("k", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    parts = encoded.mapInArrow(expect, out)
    summed = parts.groupBy("k").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # at most symbols + states + 1 rows
    keys = np.asarray(summed["k"].to_numpy())
    values = np.column_stack([summed[n].to_numpy() for n in names])
    full = np.zeros((vocab.n_symbols + states + 1, states))
    full[keys + states + 1] = values
    model.unpersist()
    return estimate(full[0], full[1 : states + 1], full[states + 1 :], vocab.prior())


@dataclass
class Model:
    vocab: Vocabulary
    parameters: Parameters
    counts: DataFrame  # all word counts, materialized


def train(
    texts: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    passes: int = PASSES,
    symbols: int = SYMBOLS,
    counted: int = COUNTED,
    sample_docs: int | None = None,
) -> Model:
    """Fit a model on all rows of ``texts``. An empty table gives a model that
    knows no word. A null text is an empty one. ``sample_docs`` has no effect any
    more; older calls name it.
    """
    counts = materialize(token_counts(texts, text_col), "lm-counts")
    vocab = learn_vocabulary(counts, symbols, counted)
    p = first_parameters(vocab, states)
    if passes:
        encoded = materialize(encode(texts, vocab, text_col), "lm-symbols")
        for _ in range(passes):
            p = baum_welch(encoded, vocab, p)
        drop_table(encoded)
    return Model(vocab, p, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, n_known, train_tokens (long),
    base_score (smoothed word distribution) and score (the model's log10
    probability of the text). Repeated rows and null ids stay rows of their
    own; a null or empty text is its end alone.
    """
    spark = docs.sparkSession
    kind = arrow_type(docs, id_col)
    shared = spark.sparkContext.broadcast((model.vocab, model.parameters))
    numbers = ("n_tokens", "n_known")
    schema = pa.schema(
        [("row", pa.int64()), (id_col, kind), *((c, pa.int64()) for c in numbers), ("base", pa.float64()), ("hmm", pa.float64())]
        + [("word", pa.binary()), ("times", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value
        row = TaskContext.get().partitionId() << 36
        base_total = math.log10(vocab.total + PRIOR * (vocab.distinct + 1))
        counted = np.log10(vocab.counts + PRIOR)
        within = np.log10(vocab.bucket_counts + PRIOR * (vocab.bucket_distinct + 1))
        end = math.log10(vocab.end_count + PRIOR) - base_total
        for batch in batches:
            for part in slices(batch, 1, max_bytes=2_000_000):
                keys, texts = part.column(0), [words_of(t) for t in part.column(1).to_pylist()]
                symbols, ends, flat, bounds, words, known, symbol = vocab.observations(texts)
                # by distinct word: log10 of count + prior, as far as known here
                share = np.zeros(len(words))
                share[known >= 0] = counted[known[known >= 0]]
                rare = symbol >= vocab.symbols
                inner = np.where(rare, share - within[np.where(rare, symbol - vocab.symbols, 0)], 0.0)
                tokens = np.diff(bounds)
                base = text_sums((share - base_total)[flat], bounds) + end if len(words) else np.full(len(texts), end)
                hmm = InStep(symbols, ends).log_likelihood(p) / math.log(10)
                seen = tokens * 0
                if len(words):
                    hmm = hmm + text_sums(inner[flat], bounds)
                    seen = text_sums((known >= 0)[flat].astype(np.int64), bounds)
                seen = seen + (vocab.end_count > 0)
                n = len(texts)
                rows = np.arange(row, row + n)
                row += n
                own = [b" " + int(r).to_bytes(8, "big") for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), keys, pa.array(tokens + 1), pa.array(seen), pa.array(base), pa.array(hmm)]
                    + [pa.array(own, pa.binary()), pa.nulls(n, pa.int64())],
                    schema=schema,
                )
                if len(words) and (known < 0).any():
                    text = np.repeat(np.arange(n), tokens)
                    tail = known[flat] < 0
                    pairs, times = np.unique(text[tail] * len(words) + flat[tail], return_counts=True)
                    if len(pairs):
                        k = len(pairs)
                        which = pairs // len(words)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[which]), keys.take(pa.array(which)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
                            + [pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())]
                            + [pa.array([words[w] for w in (pairs % len(words)).tolist()], pa.binary()), pa.array(times)],
                            schema=schema,
                        )

    fields = {"row": T.LongType(), id_col: docs.schema[id_col].dataType, "n_tokens": T.LongType(), "n_known": T.LongType()}
    fields |= {"base": T.DoubleType(), "hmm": T.DoubleType(), "word": T.BinaryType(), "times": T.LongType()}
    parts = docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in fields.items()]))
    # every row has a word to join by: a text's own row has one that no count has
    joined = parts.join(model.counts.withColumnRenamed("c", "_c"), "word", "left")
    tail = F.col("times") * F.log10(F.coalesce("_c", F.lit(0)) + F.lit(PRIOR))
    found = F.when(F.col("_c") > 0, F.col("times"))
    zero = F.lit(0)
    summed = joined.groupBy("row", id_col).agg(
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(found), zero)).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(tail), zero)).alias("base_score"),
        (F.max("hmm") + F.coalesce(F.sum(tail), zero)).alias("score"),
    )
    return summed.select(
        id_col, "n_tokens", "n_known", F.lit(model.vocab.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
