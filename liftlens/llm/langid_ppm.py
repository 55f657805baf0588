"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts of up to ``ORDER`` bytes, as counts of
byte n-grams. A byte that a context has seen costs by its share; otherwise an
escape is paid and the next shorter context is asked (method C: the escape's
weight is the number of distinct bytes seen). Statistics are frozen before
scoring, so the code length of a text is exact and repeatable. Contexts start
at the beginning of a word: a text is its words of letters, each coded with a
closing space, and a text's code length is the sum over its words.

Training counts all texts and keeps every n-gram. Up to ``MAX_NODES`` of them
are broadcast as trees. More of them stay a written table: the n-grams of the
texts to be judged are priced by joins with it, from the shortest on, the most
frequent prices are broadcast, and the other windows of a text are looked up by
a join. Both ways give the same code lengths.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, index_words, materialize, slices, text_sums, tidy

ORDER = 3
MAX_NODES = 400_000  # n-grams, or priced windows, that are broadcast
MAX_PRICES = 8 * MAX_NODES  # numbers in the broadcast of priced windows
MEMO_WINDOWS = 500_000  # cached window costs in a worker; cleared beyond
HELD_WORDS = 100_000  # distinct words, and bytes of the texts they come from, that a task
HELD_BYTES = 64_000_000  # counts before it cuts them into n-grams
UNKNOWN = "und"

_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and of bytes beyond ASCII."""
    return (text or "").lower().encode().translate(_FOLD).split()


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def windows(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the words, each between an opening and a closing space, with
    up to ``order`` bytes before it, as numbers whose last byte is the byte
    itself; and the place of each byte in its word (0: the opening space)."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = np.zeros(len(data), dtype=np.int64)
    for back in range(order, -1, -1):
        moved = np.concatenate([np.zeros(back, dtype=np.int64), data[: len(data) - back]])
        codes = (codes << 8) | np.where(place >= back, moved, 0)
    return codes, place


def ngram_counts(words: dict[bytes, int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, counts) of words with their counts: each byte of a
    word and its closing space with the contexts of 0..order bytes before it."""
    codes, place = windows(list(words), order)
    times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
    times = np.repeat(times, np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2)
    coded = place > 0  # the opening space is given
    longest, counts = _summed(codes[coded], times[coded])
    out = []
    for k in range(order + 1):
        has = longest >= 1 << 8 * k  # bytes are never 0, so the size tells the length
        out.append(_summed(longest[has] & ((1 << 8 * (k + 1)) - 1), counts[has]))
    return np.concatenate([g for g, _ in out]), np.concatenate([n for _, n in out])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_bytes(code: int) -> bytes:
    return code.to_bytes(8, "big").lstrip(b"\0")


class ContextTrees:
    """Frozen statistics of all languages; costs in bits."""

    def __init__(self, langs: list[str], rows: list[tuple[int, bytes, int]], order: int):
        self.langs, self.order = langs, order
        self.counts: list[dict[bytes, int]] = [{} for _ in langs]
        self.contexts: list[dict[bytes, tuple[int, int]]] = [{} for _ in langs]
        for lang, gram, n in rows:
            self.counts[lang][gram] = n
            total, kinds = self.contexts[lang].get(gram[:-1], (0, 0))
            self.contexts[lang][gram[:-1]] = (total + n, kinds + 1)
        self.memo: dict[int, int] = {}
        self.table = np.zeros((0, len(langs)))

    def bits(self, lang: int, gram: bytes) -> float:
        """Cost of the last byte after the context before it, with escapes down to a uniform byte."""
        counts, contexts = self.counts[lang], self.contexts[lang]
        cost = 0.0
        while True:
            seen = contexts.get(gram[:-1])
            if seen:
                total, kinds = seen
                n = counts.get(gram)
                if n:
                    return cost + math.log2((total + kinds) / n)
                cost += math.log2((total + kinds) / kinds)
            if len(gram) == 1:
                return cost + 8.0
            gram = gram[1:]

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        codes, place = windows(words, self.order)
        distinct, where = np.unique(codes, return_inverse=True)
        if len(self.memo) > MEMO_WINDOWS:
            self.memo, self.table = {}, np.zeros((0, len(self.langs)))
        memo, new = self.memo, []
        at = np.empty(len(distinct), dtype=np.int64)
        for i, code in enumerate(distinct.tolist()):
            row = memo.get(code)
            if row is None:
                gram = gram_bytes(code)
                row = memo[code] = len(self.table) + len(new)
                new.append([self.bits(k, gram) for k in range(len(self.langs))])
            at[i] = row
        if new:
            self.table = np.vstack([self.table, new])
        costs = self.table[at[where]]
        costs[place == 0] = 0.0  # the opening space is given
        return np.add.reduceat(costs, np.flatnonzero(place == 0), axis=0)


@dataclass
class GramTable:
    """Statistics that are too many for a broadcast, as a written table (lang, gram, n)."""

    langs: list[str]
    order: int
    grams: DataFrame
    max_nodes: int


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of (lang, text) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter[bytes]] = {}

        def cut() -> Iterator[pa.RecordBatch]:
            for lang, words in by_lang.items():
                if words:
                    grams, counts = ngram_counts(words, order)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
            by_lang.clear()

        # a word is cut into n-grams once for all its repetitions in several slices
        held = 0
        for batch in batches:
            for part in slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, Counter()).update(words_of(text))
                held += part.column(1).nbytes
                if held > HELD_BYTES or sum(map(len, by_lang.values())) > HELD_WORDS:
                    yield from cut()
                    held = 0
        yield from cut()

    partial = rows.mapInArrow(tidy(count), "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES
) -> ContextTrees | GramTable:
    """Statistics from all rows with a language, all n-grams kept: trees if they
    are ``max_nodes`` or fewer, else a table. No such row: no languages.

    Every language is one index of a list made on the driver; the number of
    languages is the number of distinct labels.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1..6")
    rows = docs.filter(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    summed = materialize(gram_counts(rows, order), "ppm-grams")
    langs = sorted(r[0] for r in summed.select("lang").distinct().collect())
    if summed.count() > max_nodes:
        return GramTable(langs, order, summed, max_nodes)
    kept = summed.toArrow()
    index = {x: i for i, x in enumerate(langs)}
    grams = zip(kept["lang"].to_pylist(), map(gram_bytes, kept["gram"].to_pylist()), kept["n"].to_pylist())
    return ContextTrees(langs, [(index[a], g, n) for a, g, n in grams], order)


def window_prices(grams: DataFrame, table: GramTable) -> DataFrame:
    """(code, n, bits by language), written, of the windows among ``grams`` (gram,
    n), which hold the ends of each of their n-grams too. An n-gram is priced from
    its own count, its context and the price of its end; a row of these tables
    meets at most 256 n-grams."""
    of_gram = table.grams.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("ns"))
    of_context = table.grams.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).alias("c"))
    of_context = of_context.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("cs"))
    langs = F.array(*map(F.lit, table.langs))

    def price(lang: Column, i: Column) -> Column:
        c, n = F.try_element_at("cs", lang), F.try_element_at("ns", lang)
        end, both = F.get("below", i), c["total"] + c["kinds"]
        return F.when(c.isNull(), end).when(n.isNull(), F.log2(both / c["kinds"]) + end).otherwise(F.log2(both / n))

    below, priced = None, []
    for size in range(1, table.order + 2):
        level = grams.filter((F.col("gram") >= 1 << 8 * (size - 1)) & (F.col("gram") < 1 << 8 * size))
        level = level.join(of_gram, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(of_context, "context", "left")
        if below is None:
            level = level.withColumn("below", F.transform(langs, lambda _: F.lit(8.0)))
        else:
            ends = below.select(F.col("gram").alias("end"), F.col("bits").alias("below"))
            level = level.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))).join(ends, "end")
        below = materialize(level.select("gram", "n", F.transform(langs, price).alias("bits")), "ppm-prices")
        # a window of fewer than order + 1 bytes starts with the word's opening space
        if size > table.order:
            priced.append(below)
        elif size > 1:
            priced.append(below.filter(F.shiftright("gram", 8 * (size - 1)) == 32))
    return reduce(DataFrame.union, priced).withColumnRenamed("gram", "code")


def frequent_prices(prices: DataFrame, table: GramTable) -> tuple[np.ndarray, np.ndarray]:
    """Codes, rising, and bits of the windows in the highest count classes."""
    bound = min(table.max_nodes, MAX_PRICES // len(table.langs))
    at_least, taken = 0, 0
    level = F.floor(F.log2("n") * 8).cast("long")
    for row in sorted(prices.groupBy(level.alias("l")).count().collect(), reverse=True):
        if taken + row["count"] > bound:
            at_least = row["l"] + 1
            break
        taken += row["count"]
    kept = prices.filter(level >= at_least).select("code", "bits").orderBy("code").toArrow()
    bits = kept["bits"].combine_chunks().flatten().to_numpy() if kept.num_rows else np.zeros(0)
    return kept["code"].to_numpy(), bits.reshape(-1, len(table.langs))


def identify(
    docs: DataFrame, trees: ContextTrees | GramTable, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: the id, lang_pred and score, and the columns named
    in ``carry``, which may hold the text itself and must not hold lang_pred or score.

    ``lang_pred`` has the shortest code (ties: the first by name); ``score`` is
    its share of 2^-length over all languages. A text that is null, empty or
    has no letter, or trees without languages: ``und`` and 0. Texts of any length
    are read whole. Repeated rows stay rows of their own; an empty table gives none.
    """
    others = tuple(c for c in carry if c != text_col)
    if isinstance(trees, GramTable):
        return _identify_by_table(docs, trees, id_col, text_col, carry, others)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("lang_pred", pa.string()), ("score", pa.float64())] + [(c, arrow_type(docs, c)) for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                flat, bounds, words = index_words([words_of(t) for t in texts])
                langs: list[str] = [UNKNOWN] * len(texts)
                scores = np.zeros(len(texts))
                if words and trees.langs:
                    lengths = text_sums(trees.word_bits(words)[flat], bounds)
                    best = lengths.argmin(axis=1)
                    shares = np.exp2(-(lengths - lengths.min(axis=1, keepdims=True)))
                    for i in np.flatnonzero(np.diff(bounds)).tolist():
                        if has_letter(texts[i]):
                            langs[i] = trees.langs[best[i]]
                            scores[i] = 1.0 / shares[i].sum()
                carried = dict(zip((text_col, *others), part.columns[1:]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores), *(carried[c] for c in carry)], schema=schema)

    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [docs.schema[c] for c in carry]
    )
    return docs.select(id_col, text_col, *others).mapInArrow(tidy(run), out)


def _identify_by_table(docs: DataFrame, table: GramTable, id_col: str, text_col: str, carry: tuple[str, ...], others: tuple[str, ...]) -> DataFrame:
    """``identify`` with the statistics in a table: one pass sums the broadcast
    prices and lists the other windows, whose prices are joined and added."""
    prices = window_prices(materialize(gram_counts(docs.select(F.lit("").alias("lang"), text_col), table.order).select("gram", "n"), "ppm-wanted"), table)
    order, n_langs = table.order, len(table.langs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_prices(prices, table))
    mark = "_"  # inner columns begin with more underscores than any given one
    while any(c.lower().startswith(mark) for c in (id_col, *carry)):
        mark += "_"
    row_col, letters_col, bits_col, code_col, times_col = names = tuple(mark + c for c in ("row", "letters", "bits", "code", "times"))
    more_col = mark + "more"
    types = (pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.int64(), pa.int64())
    schema = pa.schema([(c, arrow_type(docs, c)) for c in (id_col, *carry)] + list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                n = len(texts)
                flat, bounds, words = index_words([words_of(t) for t in texts])
                lengths = np.zeros((n, n_langs))
                rows = np.arange(row, row + n)
                row += n
                tail = None
                if words:
                    codes, place = windows(words, order)
                    at = np.searchsorted(known, codes)
                    found = np.zeros(len(codes), dtype=bool)
                    inside = at < len(known)
                    found[inside] = known[at[inside]] == codes[inside]
                    found &= place > 0  # the opening space is given
                    costs = np.zeros((len(codes), n_langs))
                    costs[found] = bits[at[found]]
                    lengths = text_sums(np.add.reduceat(costs, np.flatnonzero(place == 0), axis=0)[flat], bounds)
                    tail = _tail(codes, place, (place > 0) & ~found, flat, bounds, len(words))
                letters = pa.array([k > 0 and has_letter(t) for k, t in zip(np.diff(bounds).tolist(), texts)], pa.bool_())
                own = [pa.array(rows), letters, pa.array(list(lengths), pa.list_(pa.float64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
                carried = dict(zip((text_col, *others), part.columns[1:]))
                yield pa.RecordBatch.from_arrays([part.column(0), *(carried[c] for c in carry), *own], schema=schema)
                if tail is not None and len(tail[0]):
                    which, code, times = tail
                    k = len(which)
                    none = [pa.nulls(k, f.type) for f in list(schema)[: 1 + len(carry)]]
                    more = [pa.array(rows[which]), pa.nulls(k, pa.bool_()), pa.nulls(k, types[2]), pa.array(code), pa.array(times)]
                    yield pa.RecordBatch.from_arrays([*none, *more], schema=schema)

    long = T.LongType()
    kinds = (long, T.BooleanType(), T.ArrayType(T.DoubleType()), long, long)
    out = T.StructType(
        [T.StructField(c, docs.schema[c].dataType) for c in (id_col, *carry)] + [T.StructField(c, t) for c, t in zip(names, kinds)]
    )
    # written once, so that a row has one number in both uses
    parts = materialize(docs.select(id_col, text_col, *others).mapInArrow(tidy(run), out), "ppm-parts")
    tail = parts.filter(F.col(code_col).isNotNull()).select(row_col, code_col, times_col)
    tail = tail.join(prices.select(F.col("code").alias(code_col), F.col("bits").alias(more_col)), code_col)
    sums = tail.groupBy(row_col).agg(F.array(*(F.sum(F.get(more_col, F.lit(i)) * F.col(times_col)) for i in range(n_langs))).alias(more_col))
    rows = parts.filter(F.col(code_col).isNull()).join(sums, row_col, "left")
    rows = rows.withColumn(bits_col, F.transform(bits_col, lambda x, i: x + F.coalesce(F.get(more_col, i), F.lit(0.0))))
    best = F.array_min(bits_col)
    pred = F.get(F.array(*map(F.lit, table.langs)), (F.array_position(bits_col, best) - 1).cast("int"))
    share = F.aggregate(bits_col, F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), best - x))
    return rows.select(
        id_col,
        F.when(F.col(letters_col), pred).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col(letters_col), 1.0 / share).otherwise(F.lit(0.0)).alias("score"),
        *carry,
    )


def _tail(codes: np.ndarray, place: np.ndarray, wanted: np.ndarray, flat: np.ndarray, bounds: np.ndarray, n_words: int) -> tuple[np.ndarray, ...]:
    """(text, code, times) of the wanted windows of the words, by text."""
    word = (np.cumsum(place == 0) - 1)[wanted]
    distinct, code = np.unique(codes[wanted], return_inverse=True)
    per_word = np.bincount(word, minlength=n_words)
    first = np.cumsum(per_word) - per_word
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs, times = np.unique(text * n_words + flat, return_counts=True)
    text, own = pairs // n_words, pairs % n_words
    reps = per_word[own]
    inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    keys = np.repeat(text, reps) * max(1, len(distinct)) + code[np.repeat(first[own], reps) + inside]
    keys, counts = _summed(keys, np.repeat(times, reps))
    return keys // max(1, len(distinct)), distinct[keys % max(1, len(distinct))], counts
