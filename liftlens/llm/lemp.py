"""Hard negatives by inner product, with LEMP-style coordinate pruning.

``length_buckets`` deals the vectors into buckets of similar length; a bucket
holds one list per coordinate, ordered by the coordinate of the vectors scaled
to unit length.

To find rows that score at least t for an anchor, a bucket of vectors no longer
than l is left out if |anchor| * l < t. Otherwise the angle to the anchor
must have a cosine of t / (|anchor| * l) or more, which leaves a feasible range
for every coordinate. The ranges of the anchor's largest coordinates (its focus)
are cut from the sorted lists, their candidate sets are intersected, and the rest
is verified by the exact integer product. t rises with the rows found.

Anchors come in blocks of a bounded size; each block is one pass over the
buckets, and its result is written before the next one starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as vec
from .common import materialize, shared_path

BUCKET_ROWS = 8192
FOCUS = 5
TOGETHER = 64  # anchors whose whole-bucket products are taken at once
SLACK = 1e-9  # keeps rounding from narrowing a feasible range

_BUCKET = T.StructType(
    [T.StructField("size", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("rows", "ids", "unnamed", "labels", "values", "order")]
)
_HITS = "anchor_row long, window long, hit_row long, hit_id long, score long"


def _directions(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    return m / np.where(norms == 0, 1, norms)[:, None]


def length_buckets(vectors: DataFrame) -> DataFrame:
    """Buckets of ``integer_vectors`` rows (with their ``label``), written to the
    shared folder. Rows are dealt by length and then by row number, so that any
    number of equal vectors spreads over buckets."""

    def bucket(rows: list, ids: list, labels: list, values: list) -> pa.RecordBatch:
        m = vec.matrix(values)
        arrays = [np.array(rows, "<i8"), np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids]), np.array(labels, "<i8")]
        arrays += [m.astype("<i4"), np.argsort(_directions(m), axis=0, kind="stable").T.astype("<i4")]
        columns = [pa.array([len(rows)], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
        return pa.RecordBatch.from_arrays(columns, names=_BUCKET.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for i, part in enumerate(held):
                part.extend(batch.column(i).to_pylist())
            while len(held[0]) >= BUCKET_ROWS:
                yield bucket(*(part[:BUCKET_ROWS] for part in held))
                held = tuple(part[BUCKET_ROWS:] for part in held)
        if held[0]:
            yield bucket(*held)

    dealt = vectors.repartitionByRange("norm2", "row").sortWithinPartitions(F.desc("norm2"), "row")
    return materialize(dealt.select("row", "id", "label", "values").mapInArrow(run, _BUCKET), "length-buckets")


@dataclass
class Bucket:
    rows: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    directions: np.ndarray
    order: np.ndarray  # per coordinate: rows by rising direction
    lists: np.ndarray  # per coordinate: those directions
    longest: float

    @classmethod
    def read(cls, size: int, rows: bytes, ids: bytes, unnamed: bytes, labels: bytes, values: bytes, order: bytes) -> Bucket:
        m = np.frombuffer(values, "<i4").reshape(size, -1).astype(np.int64)
        unit = _directions(m)
        lists = np.frombuffer(order, "<i4").reshape(-1, size)
        long = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        named = np.frombuffer(ids, "<i8"), np.frombuffer(unnamed, bool), np.frombuffer(labels, "<i8")
        return cls(np.frombuffer(rows, "<i8"), *named, m, unit, lists, np.take_along_axis(unit.T, lists, 1), long)


def candidates(bucket: Bucket, anchor: np.ndarray, least: float) -> np.ndarray | None:
    """Positions of the rows that may score ``least`` or more; None for all."""
    if least <= 0 or not len(anchor):
        return None if least <= 0 else np.zeros(0, dtype=np.int64)
    length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
    reach = length * bucket.longest
    if reach * (1 + SLACK) < least:
        return np.zeros(0, dtype=np.int64)
    turn = np.arccos(min(1.0, least / reach * (1 - SLACK)))
    unit = anchor[: len(bucket.lists)] / length
    ranges = []
    for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
        own = np.arccos(np.clip(unit[f], -1, 1))
        low, high = np.cos(min(np.pi, own + turn)) - SLACK, np.cos(max(0.0, own - turn)) + SLACK
        start = int(np.searchsorted(bucket.lists[f], low, "left"))
        end = int(np.searchsorted(bucket.lists[f], high, "right"))
        ranges.append((end - start, int(f), start, end, low, high))
    ranges.sort()
    size, f, start, end, *_ = ranges[0]
    if size == len(bucket.rows):
        return None
    found = bucket.order[f, start:end]
    for size, f, _, _, low, high in ranges[1:]:
        if size < len(bucket.rows):
            found = found[(bucket.directions[found, f] >= low) & (bucket.directions[found, f] <= high)]
    return found


class Anchor:
    """An anchor with its windows (score from, to) and the best rows of each."""

    def __init__(self, row: int, label: int, values: np.ndarray, windows: list[tuple[float, float]], k: int):
        self.row, self.label, self.values = row, label, values
        self.windows = [(n, low, high, vec.Best(k)) for n, (low, high) in enumerate(windows)]

    @property
    def least(self) -> float:
        return min((max(low, best.least) for _, low, _, best in self.windows), default=np.inf)

    def add(self, bucket: Bucket, at: np.ndarray | slice, scores: np.ndarray, same: bool) -> None:
        labels = bucket.labels[at]
        ok = (labels == self.label) & (bucket.rows[at] != self.row) if same else labels != self.label
        ids, unnamed, rows = bucket.ids[at], bucket.unnamed[at], bucket.rows[at]
        for _, low, high, best in self.windows:
            some = np.flatnonzero(ok & (scores >= max(low, best.least)) & (scores <= high))
            if len(some):
                best.add(scores[some], ids[some], unnamed[some], rows[some])


def search(bucket: Bucket, anchors: list[Anchor], same: bool) -> None:
    """Adds the rows of a bucket to the windows of the anchors."""
    whole: list[Anchor] = []

    def products() -> None:
        if whole:
            wide = bucket.matrix.shape[1]
            for anchor, scores in zip(whole, np.stack([a.values[:wide] for a in whole]) @ bucket.matrix.T):
                anchor.add(bucket, slice(None), scores, same)
            whole.clear()

    for anchor in anchors:
        found = candidates(bucket, anchor.values, anchor.least)
        if found is None or len(found) > len(bucket.rows) // 2:
            whole.append(anchor)
            if len(whole) == TOGETHER:
                products()
        elif len(found):
            wide = bucket.matrix.shape[1]
            anchor.add(bucket, found, bucket.matrix[found] @ anchor.values[:wide], same)
    products()


def _pass(buckets: DataFrame, block: list, k: int, same: bool, path: str) -> None:
    """Writes the best ``k`` rows of each task for each window of the anchors of a block."""
    sent = buckets.sparkSession.sparkContext.broadcast((
        [(q["row"], q["label"], [(w["low"], w["high"]) for w in q["windows"]]) for q in block],
        vec.matrix([q["values"] for q in block]).astype(np.int32),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, values = sent.value
        anchors = []
        for (row, label, windows), v in zip(about, values.astype(np.int64)):
            spans = [(-np.inf if low is None else low, np.inf if high is None else high) for low, high in windows]
            anchors.append(Anchor(row, label, v, spans, k))
        for batch in batches:
            for one in batch.to_pylist():
                bucket = Bucket.read(**one)
                short = values.shape[1] < bucket.matrix.shape[1]
                if short:  # the anchors have no such coordinates
                    bucket.matrix = bucket.matrix[:, : values.shape[1]]
                kind = vec.exact(values.astype(np.int64), bucket.matrix)
                bucket.matrix = bucket.matrix.astype(kind)
                for a, v in zip(anchors, values.astype(kind)):
                    a.values = v
                search(bucket, anchors, same)
        for a in anchors:
            for n, _, _, best in a.windows:
                if len(best.scores):
                    size = len(best.scores)
                    ids = pa.array(best.ids, mask=best.unnamed)
                    columns = [pa.array(np.full(size, a.row)), pa.array(np.full(size, n)), pa.array(best.rows), ids, pa.array(best.scores)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor_row", "window", "hit_row", "hit_id", "score"])

    buckets.mapInArrow(run, _HITS).write.mode("append").parquet(path)
    sent.destroy()


def first_rows(buckets: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_row, window, rank, hit_row, hit_id, score: per anchor and window the
    first ``k`` rows of the anchor's label (``same``) or of other labels.

    ``anchors`` are rows of the vectors with ``windows``, an array of structs
    (low, high) of inclusive score bounds, null for none; equal scores come by
    rising id, rows without an id last. The anchor's own row is left out.
    """
    spark = buckets.sparkSession
    path = shared_path(spark, "lemp-hits")
    spark.createDataFrame([], _HITS).write.parquet(path)
    for block in vec.in_blocks(anchors.select("row", "label", "values", "windows")):
        _pass(buckets, block, k, same, path)
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("hit_id"), "hit_row")
    ranked = spark.read.schema(_HITS).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_row", "window", "rank", "hit_row", "hit_id", "score")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is an ``integer_vectors`` table with a ``label`` (rows without one
    take no part); ``is_anchor`` is a condition on its columns. An anchor's
    positives are its first ``positives`` other rows of the same label; its hard
    negatives for a positive are the first ``negatives`` rows of other labels
    with low % to high % of the positive's score. Fewer rows give fewer results,
    a negative positive score gives none. Repeated ids stay rows of their own.
    """
    labelled = vectors.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("long"))
    buckets = length_buckets(labelled)
    anchors = labelled.filter(is_anchor)
    every = F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    close = materialize(first_rows(buckets, anchors.withColumn("windows", every), positives, same=True), "positives")
    # equal positive scores share a window; at most ``positives`` windows an anchor
    scores = close.groupBy("anchor_row").agg(F.array_sort(F.collect_set("score")).alias("scores"))

    def window(p: Column) -> Column:
        bounds = F.call_function("div", p * low + 99, F.lit(100)), F.call_function("div", p * high, F.lit(100))
        first, last = (F.when(p >= 0, bound).otherwise(none).cast("long") for bound, none in zip(bounds, (1, 0)))
        return F.struct(first.alias("low"), last.alias("high"))

    asked = anchors.join(scores, F.col("row") == F.col("anchor_row")).drop("anchor_row").withColumn("windows", F.transform("scores", window))
    asked = materialize(asked.select("row", "id", "label", "values", "windows", "scores"), "anchors")
    far = first_rows(buckets, asked, negatives, same=False)
    windows = asked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), F.posexplode("scores").alias("window", "positive_score"))
    pairs = windows.join(close.select("anchor_row", F.col("score").alias("positive_score"), F.col("hit_id").alias("positive_id")), ["anchor_row", "positive_score"])
    found = far.select("anchor_row", "window", "rank", F.col("hit_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["anchor_row", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
