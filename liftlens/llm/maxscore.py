"""Exact top-k search over vectors by MaxScore.

The coordinates of a vector are its terms. ``build_index`` cuts the vectors
into shards; a shard holds one posting list per coordinate, ordered by value,
so its ends are the score bounds of the term and the postings that raise a
query's score are one end of the list.

``search`` splits the terms of a query by their bounds: a vector that is only in
postings of the non-essential terms cannot reach the k-th best score so far.
The postings of the essential terms are traversed, which gives the candidates;
the non-essential terms are probed from the largest bound on, and only for
candidates that can still compete. Each task carries the best rows of a query
from shard to shard, and the lists of all tasks are merged.

Queries come in blocks of a bounded size; each block is one pass over the
shards, and its result is written before the next one starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as vec
from .common import materialize, shared_path

SHARD_ROWS = 8192
PROBED = 8  # non-essential terms that are probed between two checks

_INDEX = T.StructType(
    [T.StructField("size", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("rows", "ids", "unnamed", "order", "values")]
)
_HITS = "query_row long, query_id long, vec_id long, hit_row long, score long"


def build_index(vectors: DataFrame) -> DataFrame:
    """Shards of ``integer_vectors`` rows, written to the shared folder: the rows
    and ids, and per coordinate the vectors by rising value with those values."""

    def shard(rows: list, ids: list, values: list) -> pa.RecordBatch:
        m = vec.matrix(values).T
        order = np.argsort(m, axis=1, kind="stable").astype("<i4")
        arrays = [np.array(rows, "<i8"), np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids])]
        arrays += [order, np.take_along_axis(m, order, 1).astype("<i4")]
        columns = [pa.array([len(rows)], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
        return pa.RecordBatch.from_arrays(columns, names=_INDEX.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for i, part in enumerate(held):
                part.extend(batch.column(i).to_pylist())
            while len(held[0]) >= SHARD_ROWS:
                yield shard(*(part[:SHARD_ROWS] for part in held))
                held = tuple(part[SHARD_ROWS:] for part in held)
        if held[0]:
            yield shard(*held)

    return materialize(vectors.select("row", "id", "values").mapInArrow(run, _INDEX), "maxscore")


@dataclass
class Shard:
    rows: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray
    order: np.ndarray  # per coordinate: vectors by rising value
    values: np.ndarray  # per coordinate: those values
    forward: np.ndarray  # per coordinate: value of each vector, to probe

    @classmethod
    def read(cls, size: int, rows: bytes, ids: bytes, unnamed: bytes, order: bytes, values: bytes) -> Shard:
        lists = np.frombuffer(order, "<i4").reshape(-1, size)
        sorted_values = np.frombuffer(values, "<i4").reshape(-1, size)
        forward = np.empty(lists.shape, dtype=np.int64)
        np.put_along_axis(forward, lists, sorted_values, 1)
        return cls(np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(unnamed, bool), lists, sorted_values, forward)

    def raising(self, term: int, weight: int) -> np.ndarray:
        """The postings of a term that raise the score of a query with this weight."""
        if weight > 0:
            return self.order[term, np.searchsorted(self.values[term], 0, "right") :]
        return self.order[term, : np.searchsorted(self.values[term], 0, "left")]


def search(shard: Shard, query: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of all vectors of the shard that score ``least`` or more."""
    terms = np.flatnonzero(query[: len(shard.forward)])
    weights = query[terms]
    ends = np.where(weights > 0, shard.values[terms, -1], shard.values[terms, 0]) if len(terms) else weights
    bounds = np.maximum(weights * ends, 0)
    rising = np.argsort(bounds, kind="stable")
    essential = np.cumsum(bounds[rising]) >= least
    first, others = rising[essential], rising[~essential][::-1]
    if least <= 0:  # a vector outside all postings scores 0 or less, which may be enough
        found = np.arange(len(shard.rows))
    else:
        seen = np.zeros(len(shard.rows), dtype=bool)
        for i in first[::-1]:
            seen[shard.raising(terms[i], weights[i])] = True
            if seen.all():
                break
        found = np.flatnonzero(seen)
    lists = shard.forward[terms[first]]
    scores = weights[first] @ (lists if len(found) == len(shard.rows) else lists[:, found])
    left = float(bounds[others].sum())
    for at in range(0, len(others), PROBED):
        able = scores + left >= least
        found, scores = found[able], scores[able]
        if not len(found):
            break
        probe = others[at : at + PROBED]
        scores = scores + weights[probe] @ shard.forward[np.ix_(terms[probe], found)]
        left -= float(bounds[probe].sum())
    able = scores >= least
    return found[able], scores[able]


def _pass(index: DataFrame, queries: list, k: int, path: str) -> None:
    """Writes the best ``k`` rows of each task for each query of a block."""
    sent = index.sparkSession.sparkContext.broadcast((
        np.array([q["row"] for q in queries], dtype=np.int64),
        np.array([q["id"] for q in queries], dtype=np.int64),
        vec.matrix([q["values"] for q in queries]).astype(np.int32),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, block = sent.value
        best = [vec.Best(k) for _ in rows]
        for batch in batches:
            for one in batch.to_pylist():
                shard = Shard.read(**one)
                kind = vec.exact(block.astype(np.int64), shard.forward)
                shard.forward = shard.forward.astype(kind)
                for q, values in enumerate(block.astype(kind)):
                    at, scores = search(shard, values, best[q].least)
                    other = shard.rows[at] != rows[q]
                    at, scores = at[other], scores[other]
                    if len(at):
                        best[q].add(scores, shard.ids[at], shard.unnamed[at], shard.rows[at])
        sizes = [len(b.scores) for b in best]
        if sum(sizes):
            hits = [np.repeat(rows, sizes), np.repeat(ids, sizes)]
            named = pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.unnamed for b in best]))
            rest = [np.concatenate([b.rows for b in best]), np.concatenate([b.scores for b in best])]
            columns = [*map(pa.array, hits), named, *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "hit_row", "score"])

    index.mapInArrow(run, _HITS).write.mode("append").parquet(path)
    sent.destroy()


def top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the index with the highest
    inner product for each query (all, if fewer), equal scores by rising id.

    ``queries`` are rows of the ``integer_vectors`` table of the index and have
    ids; a query's own row is no candidate, a copy of it under any id is one. A
    repeated query id has one ranking for each of its rows. Rows without an id
    are candidates and come last among equals. Vectors of different length
    are compared as if filled up with zeros. No queries or no vectors: no rows.
    """
    spark = index.sparkSession
    path = shared_path(spark, "maxscore-hits")
    spark.createDataFrame([], _HITS).write.parquet(path)
    for block in vec.in_blocks(queries):
        _pass(index, block, k, path)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "hit_row")
    ranked = spark.read.schema(_HITS).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
