"""Integer vectors for the exact vector searches, and queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, materialize

SCALE = 256
LIMIT = 1 << 24  # larger integer components would not give scores that fit a long
BLOCK_BYTES = 8_000_000  # queries that are broadcast at once


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: dict[str, Column] | None = None) -> DataFrame:
    """Table of row, id, norm2, values and the ``carry`` columns, written to the
    shared folder: one row per vector, each component x as floor(256 * x).

    ``values`` are little-endian 32-bit integers, ``norm2`` their sum of squares,
    ``row`` a number of the input row. Vectors that are null, or hold a null, a
    non-finite component or one beyond ``LIMIT``, are left out; an empty vector
    stays, without components. Null ids stay null, repeated ids stay apart.
    """
    carry = carry or {}
    more = len(carry)
    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), *(c.alias(k) for k, c in carry.items()))
    schema = pa.schema(
        [("row", pa.int64()), ("id", pa.int64()), ("norm2", pa.int64()), ("values", pa.binary())]
        + [(k, arrow_type(read, k)) for k in carry]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(SCALE * flat)
                bad = ~(np.abs(scaled) <= LIMIT)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            fits = (wrong[bounds[1:]] == wrong[bounds[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            numbers = np.where(bad, 0, scaled).astype("<i4")
            squares = np.concatenate([[0], np.cumsum(numbers.astype(np.int64) ** 2)])
            norms = squares[bounds[1:]] - squares[bounds[:-1]]
            at = np.flatnonzero(fits)
            kept = batch.take(pa.array(at))
            columns = [
                pa.array(row + at),
                kept.column(0),
                pa.array(norms[at]),
                pa.array([numbers[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *(kept.column(2 + i) for i in range(more))], schema=schema)
            row += len(batch)

    fields = [T.StructField(n, t) for n, t in (("row", T.LongType()), ("id", T.LongType()), ("norm2", T.LongType()), ("values", T.BinaryType()))]
    fields += [T.StructField(k, read.schema[k].dataType) for k in carry]
    return materialize(read.mapInArrow(run, T.StructType(fields)), "vectors")


def matrix(values: list[bytes]) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(values), max((len(v) // 4 for v in values), default=0)), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v) // 4] = np.frombuffer(v, dtype="<i4")
    return out


def exact(left: np.ndarray, right: np.ndarray) -> type:
    """The fastest type in which inner products of rows of the two are exact."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64


def in_blocks(queries: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """The rows of ``queries`` in blocks of about ``limit`` bytes of ``values``,
    so that one block at a time is on the driver and in a broadcast. ``queries``
    has a ``row`` number and is read once for each block."""
    total = queries.agg(F.sum(F.octet_length("values") + 64)).first()[0] or 0
    count = -(-total // limit)
    for block in range(count):
        yield queries.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == block).collect()


class Best:
    """The first ``k`` of the rows seen so far: falling score, then rising id
    (rows without an id last), then row."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = self.rows = np.zeros(0, dtype=np.int64)
        self.unnamed = np.zeros(0, dtype=bool)

    @property
    def least(self) -> float:
        """Score that a further row must reach."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            some = scores >= last
            scores, ids, unnamed, rows = scores[some], ids[some], unnamed[some], rows[some]
        scores = np.concatenate([self.scores, scores.astype(np.int64)])
        ids, unnamed, rows = (np.concatenate([a, b]) for a, b in ((self.ids, ids), (self.unnamed, unnamed), (self.rows, rows)))
        order = np.lexsort((rows, ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed, self.rows = scores[order], ids[order], unnamed[order], rows[order]
