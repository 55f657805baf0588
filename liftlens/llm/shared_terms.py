"""Ranked lexical search for many items at once, with their common parts shared.

An item's score of a document is a sum over the item's terms. ``plan`` mines the
term sets that items have in common: terms that occur in the same items become
one node, and the pair of nodes that most items share becomes a node of its
own, again and again, as long as two items share it. Each item ends as a short
list of nodes, and the nodes form a graph whose edges are shared sums.

``search`` reads the documents once for each block of items. A first pass
writes the documents' lengths and their counts of the block's terms (the
postings) and gives the corpus counts. A second pass turns the postings of
a run of documents into partial sums (one accumulator per document and node), each
made once and from smaller ones along the graph, adds up the nodes of each item
and keeps the best documents of each task; the lists of all tasks are merged.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as vec
from .common import materialize, shared_path

BLOCK_TERMS = 200_000  # terms of items that are searched at once
ACCUMULATORS = 2_000_000  # numbers held at once by a task, over documents and nodes
PIECE_BYTES = 4_000_000  # texts are cut into words in pieces of about this size
PLANNED_PAIRS = 2_000_000  # pairs of nodes that are counted for the graph; results don't depend on it

# 0-9, a-z and everything beyond ASCII are word bytes
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_HITS = "item long, doc_id long, unnamed boolean, score long, seq long"


def terms_in(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text (letters, digits and all beyond ASCII, A-Z
    lower-cased), piece by piece; no word is cut."""
    folded = (text or "").encode().lower().translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


@dataclass
class Plan:
    """Nodes of a block of items. Node i < len(terms) is the sum over the terms
    of that group; later nodes are the sum of two earlier ones."""

    vocab: dict[bytes, int]
    group: np.ndarray  # node of each term
    sums: list[tuple[int, int]]
    items: list[tuple[int, list[int]]]  # item number and its nodes

    @property
    def leaves(self) -> int:
        return int(self.group.max(initial=-1)) + 1

    @property
    def nodes(self) -> int:
        return self.leaves + len(self.sums)


def plan(items: list[tuple[int, list[bytes]]]) -> Plan:
    """The query-sharing graph of (item number, distinct terms)."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for n, (_, terms) in enumerate(items):
        for t in terms:
            holders[t].append(n)
    groups: dict[tuple[int, ...], int] = {}
    vocab = {t: i for i, t in enumerate(holders)}
    group = np.array([groups.setdefault(tuple(who), len(groups)) for who in holders.values()], dtype=np.int64)
    nodes: list[set[int]] = [set() for _ in items]
    for who, node in groups.items():
        for n in who:
            nodes[n].add(node)
    shared = {node for who, node in groups.items() if len(who) > 1}
    sums: list[tuple[int, int]] = []
    # the pairs of shared nodes of the items, the shortest items first, as far as they are counted
    mine = [sorted(s & shared) for s in nodes]
    pairs: Counter[tuple[int, int]] = Counter()
    left = PLANNED_PAIRS
    taking = []
    for n in sorted(range(len(mine)), key=lambda n: len(mine[n])):
        left -= len(mine[n]) * (len(mine[n]) - 1) // 2
        if left < 0:
            break
        pairs.update(combinations(mine[n], 2))
        taking.append(n)
    heap = [(-c, p) for p, c in pairs.items() if c > 1]
    heapq.heapify(heap)
    live = [set(mine[n]) if n in set(taking) else set() for n in range(len(mine))]
    while heap:
        count, (a, b) = heapq.heappop(heap)
        if pairs[a, b] != -count:  # counted anew since
            if pairs[a, b] > 1:
                heapq.heappush(heap, (-pairs[a, b], (a, b)))
            continue
        new = len(groups) + len(sums)
        sums.append((a, b))
        gained: Counter[int] = Counter()
        for n, held in enumerate(live):
            if a in held and b in held:
                held -= {a, b}
                nodes[n] = nodes[n] - {a, b} | {new}
                for c in held:
                    pairs[min(a, c), max(a, c)] -= 1
                    pairs[min(b, c), max(b, c)] -= 1
                gained.update(held)
                held.add(new)
        del pairs[a, b]
        for c, times in gained.items():
            pairs[c, new] = times
            if times > 1:
                heapq.heappush(heap, (-times, (c, new)))
    return Plan(vocab, group, sums, [(number, sorted(s)) for (number, _), s in zip(items, nodes)])


def weight(docs: int, holding: int) -> int:
    """A term's weight from the documents with words and those holding it."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def number_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Table of item (a number), item_id, terms (distinct) and values (their
    bytes, which size the blocks), written to the shared folder. Rows with equal
    ids stay apart; items without a word have no row."""
    kind = T.StructType(
        [T.StructField("item_id", items.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("values", T.BinaryType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                terms = sorted({w for piece in terms_in(text.as_py()) for w in piece})
                if terms:
                    columns = [batch.column(0).slice(i, 1).cast(schema.field(0).type), pa.array([terms], schema.field(1).type), pa.array([bytes(8 * len(terms))])]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = items.select(id_col, text_col).mapInArrow(run, kind)
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "items")


def _postings(docs: DataFrame, vocab: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (words), terms and counts of the block's terms, for documents
    with words; written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            at, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                n, held = 0, Counter()
                for piece in terms_in(text.as_py()):
                    n += len(piece)
                    held.update(map(get, piece, repeat(-1)))
                held.pop(-1, None)
                if n:
                    at.append(i)
                    lengths.append(n)
                    terms.append(np.fromiter(held.keys(), "<i4", len(held)).tobytes())
                    counts.append(np.fromiter(held.values(), "<i8", len(held)).tobytes())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(read.mapInArrow(run, "doc_id long, n long, terms binary, counts binary"), "term-counts")
    sent.destroy()
    return found


def _holding(postings: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(held, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "docs"])

    counted = postings.select("terms").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    return {r["term"]: r["docs"] for r in counted.collect()}  # at most one row per term of the block


def accumulate(about: Plan, weights: np.ndarray, lengths: np.ndarray, runs: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Scores of all items of a plan (rows) for a run of documents (columns):
    ``runs`` is the document of each posting. Exact: all sums stay below 2^53."""
    m = 100 - 50 + (50 * lengths * docs) // words
    parts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[runs]))
    size = len(lengths)
    sums = np.bincount(about.group[terms] * size + runs, weights=parts, minlength=about.leaves * size).reshape(about.leaves, size)
    table = np.empty((about.nodes, size))
    table[: about.leaves] = sums
    for n, (a, b) in enumerate(about.sums, about.leaves):
        np.add(table[a], table[b], out=table[n])
    return np.stack([table[nodes].sum(axis=0) for _, nodes in about.items])


def _pass(postings: DataFrame, about: Plan, weights: np.ndarray, docs: int, words: int, k: int, path: str) -> None:
    """Writes the best ``k`` documents of each task for each item of a block."""
    sent = postings.sparkSession.sparkContext.broadcast((about.group, about.sums, about.items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums, items, w = sent.value
        p = Plan({}, group, sums, items)
        best = [vec.Best(k) for _ in items]
        step = max(1, ACCUMULATORS // (p.nodes + len(items)))
        seq = 0
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                ids, unnamed = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                terms = batch.column(2).to_pylist()
                runs = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
                scores = accumulate(
                    p, w, batch.column(1).to_numpy(), runs, np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i8"), docs, words
                )
                rows = np.arange(seq, seq + len(terms))
                least = np.array([max(b.least, 1) for b in best])
                for i in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                    at = np.flatnonzero(scores[i] >= least[i])
                    best[i].add(scores[i, at], ids[at], unnamed[at], rows[at])
                seq += len(terms)
        for (number, _), b in zip(items, best):
            if len(b.scores):
                columns = [np.full(len(b.scores), number), b.ids, b.unnamed, b.scores, b.rows]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc_id", "unnamed", "score", "seq"])

    postings.mapInArrow(run, _HITS).write.mode("append").parquet(path)
    sent.destroy()


def search(
    docs: DataFrame, items: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score
    above 0 (all, if fewer), equal scores by rising doc_id.

    Null and empty texts have no terms: such documents count nowhere, such items
    find nothing. Texts of any length are read whole. Documents without an id come
    last among equals; equal ids stay rows of their own, and repeated items
    each get their ranking. Empty tables give no rows.
    """
    spark: SparkSession = docs.sparkSession
    numbered = number_items(items, item_id, item_text)
    path = shared_path(spark, "lexical-hits")
    spark.createDataFrame([], _HITS).write.parquet(path)
    for block in vec.in_blocks(numbered, 8 * BLOCK_TERMS):
        about = plan([(r["row"], [bytes(t) for t in r["terms"]]) for r in block])
        postings = _postings(docs, about.vocab, doc_id, doc_text)
        corpus = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
        if not corpus["docs"]:
            break
        holding = _holding(postings, len(about.vocab))
        weights = np.array([weight(corpus["docs"], holding.get(i, 0)) for i in range(len(about.vocab))], dtype=np.int64)
        _pass(postings, about, weights, corpus["docs"], corpus["words"], k, path)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "unnamed", "doc_id", "seq")
    ranked = spark.read.schema(_HITS).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = ranked.join(numbered.select(F.col("row").alias("item"), "item_id"), "item")
    return named.select("item_id", "rank", F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "score")
