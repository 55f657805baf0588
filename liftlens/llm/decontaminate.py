"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores, for shards of about a megabyte of text each, the
postings of every token: where it stands in the shard. The index is a Parquet
table; a shard is one row, so a search reads it in parallel and each document
lies whole in one shard.

``find`` searches test items in it. Items become windows of 13 words (a
shorter item is one window). Per shard, a window's posting lists, shifted by
the word's offset in the window, are intersected from the rarest word on.
With ``slop`` the words may also lie apart: in order, within that many further
words. Items come to the tasks in blocks of a bounded number of words; each
block is one search over the index, and the matches are joined up per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LARGE_ROWS, arrow_type, index_words, large_rows, materialize, shared_path, slices, tidy

WINDOW = 13
SHARD_BYTES = 1_000_000
BLOCK_WORDS = 1_000_000  # words of test items that are broadcast at once
HELD_POSTINGS = 250_000  # postings that a search follows at once (one window's at least)
HIT_SHARE = 20  # contaminated: a hit word among this many

# 0-9, a-z and everything beyond ASCII are word bytes
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and all beyond ASCII; A-Z lower-cased."""
    return (text or "").encode().lower().translate(_FOLD).split()


@dataclass
class Shard:
    """Postings of one shard. ``positions`` holds the lists one after another,
    each rising; list i is ``positions[starts[i]:starts[i + 1]]``."""

    terms: list[bytes]
    starts: np.ndarray
    positions: np.ndarray
    bounds: np.ndarray  # start of each document and the end of the last

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Shard:
        flat, bounds, terms = index_words(texts)
        order = np.argsort(flat, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(terms)))])
        return cls(terms, starts, order, bounds)

    def keys(self) -> np.ndarray:
        """All postings as term * size + position, rising."""
        size = int(self.bounds[-1])
        return np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * size + self.positions


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder: shard, ids, lengths, terms,
    starts, positions (the last three null for a shard without words). Null
    texts are documents without words; repeated ids stay apart."""
    kind = arrow_type(docs, id_col)
    schema = pa.schema(
        [("shard", pa.int64()), ("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary()))]
        + [("starts", pa.binary()), ("positions", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, SHARD_BYTES, 5000):
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                s = Shard.of(texts)
                row = [shard, part.column(0).to_pylist(), [len(t) for t in texts], s.terms]
                row += [s.starts.astype("<i4").tobytes(), s.positions.astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
                shard += 1

    long, binary = T.LongType(), T.BinaryType()
    fields = {"shard": long, "ids": T.ArrayType(docs.schema[id_col].dataType), "lengths": T.ArrayType(long)}
    fields |= {"terms": T.ArrayType(binary), "starts": binary, "positions": binary}
    rows = docs.select(id_col, text_col).mapInArrow(tidy(run), T.StructType([T.StructField(k, v) for k, v in fields.items()]))
    return materialize(rows, "postings", options=LARGE_ROWS)


@dataclass
class Queries:
    """Windows of a block of items: word numbers (-1 beyond a window's end), lengths, item of each."""

    vocab: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]], width: int) -> Queries:
        vocab: dict[bytes, int] = {}
        rows: dict[tuple, None] = {}
        for item, words in items:
            numbers = [vocab.setdefault(w, len(vocab)) for w in words]
            for i in range(max(1, len(numbers) - width + 1)):
                if numbers:
                    rows[item, tuple(numbers[i : i + width])] = None
        windows = np.full((len(rows), width), -1, dtype=np.int64)
        for i, (_, w) in enumerate(rows):
            windows[i, : len(w)] = w
        return cls(vocab, windows, (windows >= 0).sum(axis=1), [item for item, _ in rows])


def search(shard: Shard, queries: Queries, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches in a shard: (window number, first position, last position).

    Windows are followed in runs whose rarest words have ``HELD_POSTINGS``
    postings or fewer together (one window at least), so that windows of common
    words need no more memory than others."""
    none = np.zeros(0, dtype=np.int64)
    size = int(shard.bounds[-1])
    if not size or not len(queries.windows):
        return none, none, none
    here = np.full(len(queries.vocab) + 1, -1, dtype=np.int64)  # the last entry serves the padding
    get = queries.vocab.get
    for i, term in enumerate(shard.terms):
        number = get(term, -1)
        if number >= 0:
            here[number] = i
    terms = here[queries.windows]
    pad = queries.windows < 0
    alive = np.flatnonzero(((terms >= 0) | pad).all(axis=1))
    if not len(alive):
        return none, none, none
    terms, pad, lengths = terms[alive], pad[alive], queries.lengths[alive]
    sizes = np.diff(shard.starts)
    often = np.where(pad, np.iinfo(np.int64).max, sizes[np.where(pad, 0, terms)])
    rarity = np.argsort(often, axis=1, kind="stable")  # offsets by falling rarity
    keys = shard.keys()
    reps = sizes[terms[np.arange(len(alive)), rarity[:, 0]]] * (slop + 1)
    ends = np.cumsum(reps)
    found, at = [], 0
    while at < len(alive):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - reps[at] + HELD_POSTINGS, "right")))
        window, first, last = _follow(shard, keys, terms[at:stop], lengths[at:stop], rarity[at:stop], slop)
        found.append((alive[window + at], first, last))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found))


def _follow(shard: Shard, keys: np.ndarray, terms: np.ndarray, lengths: np.ndarray, rarity: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of a run of windows (row, first position, last position) whose
    words all occur in the shard; ``rarity`` has the offsets of each by falling rarity."""
    size, width = int(shard.bounds[-1]), terms.shape[1]

    def is_posting(term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term * size + position
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return (keys[at] == wanted) & (position >= 0) & (position < size)

    rows = np.arange(len(terms))
    rarest = terms[rows, rarity[:, 0]]
    reps = np.diff(shard.starts)[rarest]
    window = np.repeat(rows, reps)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(reps) - reps, reps)
    first = shard.positions[shard.starts[rarest][window] + inside] - rarity[window, 0]
    if slop == 0:
        for k in range(1, width):
            offset = rarity[window, k]
            left = k >= lengths[window]
            fits = left | is_posting(np.where(left, 0, terms[window, offset]), first + offset)
            window, first = window[fits], first[fits]
        fits = first >= 0
        window, first = window[fits], first[fits]
        last = first + lengths[window] - 1
    else:
        gaps = np.arange(slop + 1)
        window, first = np.repeat(window, slop + 1), (first[:, None] - gaps).ravel()
        fits = is_posting(terms[window, 0], first)
        pairs = np.unique(window[fits] * size + first[fits])
        window, first = pairs // size, pairs % size
        last = first.copy()
        for k in range(1, width):
            more = k < lengths[window]
            term = np.where(more, terms[window, k], 0)
            at = np.searchsorted(keys, term * size + last + 1)
            found = keys[np.minimum(at, len(keys) - 1)]
            ok = ~more | ((at < len(keys)) & (found // size == term) & (found % size - first < lengths[window] + slop))
            last = np.where(more, found % size, last)
            window, first, last = window[ok], first[ok], last[ok]
    doc = np.searchsorted(shard.bounds, first, side="right") - 1
    ok = last < shard.bounds[doc + 1] if len(doc) else np.zeros(0, dtype=bool)
    return window[ok], first[ok], last[ok]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end exclusive) joined where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, id_col: str, text_col: str, unnamed: bool) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of at most BLOCK_WORDS words (one item at least)."""
    if not unnamed:
        items = items.filter(F.col(id_col).isNotNull())
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for item, text in items.select(id_col, text_col).toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


def find(
    index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", text_col: str = "text", unnamed: bool = False
) -> DataFrame | None:
    """Matches per document and item, written to the shared folder: shard, at (the
    document's place in its shard), item, spans (word positions from the document's
    start, end exclusive, joined where they touch). None if there are no items.

    Items without words match nothing; equal ids are one item. Items with a
    null id match nothing either, or if ``unnamed`` they are one item, null.
    """
    spark = index.sparkSession
    kind = arrow_type(items, item_col)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("item", kind), ("spans", pa.list_(span))])
    out = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", items.schema[item_col].dataType)]
        + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    )
    path = None
    for block in _blocks(items, item_col, text_col, unnamed):
        path = path or shared_path(spark, "matches")
        shared = spark.sparkContext.broadcast(Queries.of(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    number, lengths, terms, starts, positions = (batch.column(c)[i].as_py() for c in range(5))
                    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                    places = (np.frombuffer(x, dtype="<i4").astype(np.int64) for x in (starts, positions))
                    which, first, last = search(Shard(terms, *places, bounds), queries, slop)
                    found: dict[tuple, list[tuple[int, int]]] = {}
                    doc = np.searchsorted(bounds, first, side="right") - 1
                    for w, d, lo, hi in zip(which.tolist(), doc.tolist(), (first - bounds[doc]).tolist(), (last + 1 - bounds[doc]).tolist()):
                        found.setdefault((d, queries.items[w]), []).append((lo, hi))
                    rows = [
                        {"shard": number, "at": d, "item": item, "spans": [{"start": a, "end": b} for a, b in merged(spans)]}
                        for (d, item), spans in found.items()
                    ]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

        # written block by block, so that one block's windows are held at a time
        found = index.select("shard", "lengths", "terms", "starts", "positions").mapInArrow(tidy(run), out)
        with large_rows(spark):
            found.write.mode("append").parquet(path)
        shared.destroy()
    return None if path is None else spark.read.schema(out).parquet(path)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    slop: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    unnamed: bool = False,
) -> DataFrame:
    """One row per input row: the id, n_words, n_hit (words inside a match),
    items (sorted ids as text of the items found), contaminated (a hit, and one
    word in HIT_SHARE or more is hit).

    Null and empty texts have no words. Repeated rows and null ids are
    documents of their own. No items or no documents: nothing is hit.
    ``unnamed``: passages of items with a null id are hits too, and are not in
    ``items``; otherwise these items are left out.
    """
    index = build_index(docs, id_col, text_col)
    zipped = F.posexplode(F.arrays_zip("ids", "lengths"))
    every = index.select("shard", zipped.alias("at", "d")).select(
        "shard", F.col("at").cast("long").alias("at"), F.col("d.ids").alias("id"), F.col("d.lengths").alias("n_words")
    )
    matches = find(index, items, window, slop, item_col, item_text_col, unnamed)
    if matches is None:
        rows = every.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        per_doc = matches.groupBy("shard", "at").agg(
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
        zero = F.lit(0).cast("long")
        covered = F.aggregate(
            "spans",
            F.struct(zero.alias("n"), zero.alias("end")),
            lambda a, s: F.struct(
                (a["n"] + F.greatest(zero, s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")
            ),
            lambda a: a["n"],
        )
        hits = per_doc.select("shard", "at", "items", covered.alias("n_hit"))
        rows = every.join(hits, ["shard", "at"], "left").select(
            "id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
    hit = (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", hit.alias("contaminated"))
