"""Overlap of the users two models score.

For every user scored by both models inside the date window, each model is
represented by the user's best decile (lowest) and best score (highest); the
two may come from different rows. The pair frame is built by one grouping on
the user id with conditional aggregates instead of two groupings and a join:
one shuffle, partial aggregation map-side (a user with a third of all score
rows collapses before the shuffle), and no join at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlens.constants import BANDS, CORRELATION_TEXT, DECILES
from liftlens.functions.columns import band, count_label, percent_label
from liftlens.functions.columns import in_window
from liftlens.functions.labels import number_text
from liftlens.params import Params


def _window(scores: DataFrame, p: Params, models) -> DataFrame:
    return scores.filter(
        in_window("date", p) & F.col("tid").isin(list(models))
    )


def best_scores(scores: DataFrame, p: Params, models=None) -> DataFrame:
    """``tid, xid, best_decile, best_score`` per model and user (NULLs skipped)."""
    models = list(models if models is not None else p.models)
    return (
        _window(scores, p, models)
        .groupBy("tid", "xid")
        .agg(F.min("decile").alias("best_decile"), F.max("score").alias("best_score"))
    )


def best_score_pairs(scores: DataFrame, p: Params, model1: str, model2: str) -> DataFrame:
    """``xid, tid1Decile, tid1Score, tid2Decile, tid2Score`` for users with at
    least one score row of each model (equal to an inner join of the two
    per-model best-score frames on ``xid``)."""

    def of(model: str, c: str):
        return F.when(F.col("tid") == model, F.col(c))

    return (
        _window(scores, p, [model1, model2])
        .groupBy("xid")
        .agg(
            F.min(of(model1, "decile")).alias("tid1Decile"),
            F.max(of(model1, "score")).alias("tid1Score"),
            F.count(of(model1, "tid")).alias("_n1"),
            F.min(of(model2, "decile")).alias("tid2Decile"),
            F.max(of(model2, "score")).alias("tid2Score"),
            F.count(of(model2, "tid")).alias("_n2"),
        )
        .filter((F.col("_n1") > 0) & (F.col("_n2") > 0))
        .drop("_n1", "_n2")
    )


_STATE = ("count", "mean1", "mean2", "square1", "square2", "product", "least1", "most1", "least2", "most2")


def overlap_state(pairs: DataFrame) -> DataFrame:
    """What the overlap reports need, per (model 1 decile, model 2 decile): the
    users, and of the two scores (a missing one counting as 0) the means, the sums
    of squared deviations and of their product, the least and the greatest.

    At most 121 rows, however many users. Rows of several states over different
    users (days, regions) can be put together and merged, see :func:`merge_state`.
    """
    x, y = (F.coalesce(c, F.lit(0.0)) for c in ("tid1Score", "tid2Score"))
    n = F.count(F.lit(1))
    return pairs.groupBy("tid1Decile", "tid2Decile").agg(
        n.alias("count"),
        F.avg(x).alias("mean1"),
        F.avg(y).alias("mean2"),
        (F.var_pop(x) * n).alias("square1"),
        (F.var_pop(y) * n).alias("square2"),
        (F.covar_pop(x, y) * n).alias("product"),
        F.min(x).alias("least1"),
        F.max(x).alias("most1"),
        F.min(y).alias("least2"),
        F.max(y).alias("most2"),
    )


def merge_state(state: DataFrame, *keys: str) -> DataFrame:
    """The state of all rows with equal ``keys`` (all rows, without keys): counts
    are added, means weighted, and the sums of deviations moved to the common
    mean, so nothing is lost by cancellation. Works on a few rows per state."""
    of = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("count").over(of)
    moved = state.select(
        *keys,
        *_STATE,
        (F.sum(F.col("mean1") * F.col("count")).over(of) / total).alias("_m1"),
        (F.sum(F.col("mean2") * F.col("count")).over(of) / total).alias("_m2"),
    )
    d1, d2 = F.col("mean1") - F.col("_m1"), F.col("mean2") - F.col("_m2")
    return moved.groupBy(*keys).agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"),
        F.max("_m1").alias("mean1"),
        F.max("_m2").alias("mean2"),
        F.sum(F.col("square1") + F.col("count") * d1 * d1).alias("square1"),
        F.sum(F.col("square2") + F.col("count") * d2 * d2).alias("square2"),
        F.sum(F.col("product") + F.col("count") * d1 * d2).alias("product"),
        F.min("least1").alias("least1"),
        F.max("most1").alias("most1"),
        F.min("least2").alias("least2"),
        F.max("most2").alias("most2"),
    )


def overlap_by_decile(state: DataFrame) -> DataFrame:
    """Users per (model 1 decile, model 2 decile); only non-empty cells. Takes an
    :func:`overlap_state`, of one or of several parts of the users."""
    return state.groupBy("tid1Decile", "tid2Decile").agg(F.sum("count").alias("count"))


def overlap_by_band(decile_cells: DataFrame) -> DataFrame:
    """Users per (model 1 band, model 2 band), from the decile cells: the band
    is a function of the decile, so re-adding at most 121 cells replaces a
    second pass over the scores."""
    return (
        decile_cells.select(
            band("tid1Decile").alias("DecileGroup1"), band("tid2Decile").alias("DecileGroup2"), "count"
        )
        .groupBy("DecileGroup1", "DecileGroup2")
        .agg(F.sum("count").alias("count"))
    )


def score_correlation(state: DataFrame) -> DataFrame:
    """One row: ``n_users`` scored by both models and the Pearson correlation
    of their best scores, a missing score counting as 0, from an
    :func:`overlap_state`. NULL for fewer than two users or a constant score."""
    varies = (F.col("least1") < F.col("most1")) & (F.col("least2") < F.col("most2"))
    correlation = F.try_divide(F.col("product"), F.sqrt("square1") * F.sqrt("square2"))
    return merge_state(state).select(F.col("count").alias("n_users"), F.when(varies, correlation).alias("correlation"))


def _matrix(spark: SparkSession, cells: DataFrame, row: str, col: str, values) -> DataFrame:
    values = list(values)
    axis = spark.createDataFrame([(v,) for v in values], f"{row} {cells.schema[row].dataType.simpleString()}")
    spine = axis.select(row, F.explode(F.array(*[F.lit(v) for v in values])).alias(col))
    # Cells restricted to the axis values: at most len(values)^2 rows, so the
    # broadcast side has a fixed bound.
    inside = cells.filter(F.col(row).isin(values) & F.col(col).isin(values)).select(
        row, col, F.col("count").alias("_n")
    )
    dense = spine.join(F.broadcast(inside), [row, col], "left").select(
        row, col, F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n")
    )
    column_total = F.sum("n").over(Window.partitionBy(col))
    pct = F.try_divide(F.col("n"), column_total)
    return dense.select(
        row,
        col,
        "n",
        pct.alias("pct"),
        count_label("n").alias("n_label"),
        percent_label(pct).alias("pct_label"),
        (F.col(row) == F.col(col)).alias("is_diagonal"),
    )


def overlap_decile_matrix(decile_cells: DataFrame) -> DataFrame:
    """All 100 cells of the decile overlap: ``n`` (0 when empty), ``pct`` = share
    of the model 2 decile's column, labels and the diagonal flag."""
    return _matrix(decile_cells.sparkSession, decile_cells, "tid1Decile", "tid2Decile", DECILES)


def overlap_band_matrix(band_cells: DataFrame) -> DataFrame:
    """All 9 cells of the band overlap, same columns as the decile matrix."""
    return _matrix(band_cells.sparkSession, band_cells, "DecileGroup1", "DecileGroup2", BANDS)


def overlap_decile_wide(decile_matrix: DataFrame) -> DataFrame:
    """Ten rows (model 1 decile) by ten count columns ``"1"``..``"10"`` (model 2)."""
    return decile_matrix.groupBy("tid1Decile").pivot("tid2Decile", list(DECILES)).agg(F.sum("n"))


def with_sentence(correlation: DataFrame) -> DataFrame:
    """Adds the report's sentence about the ``correlation`` column."""
    return correlation.withColumn("correlation_text", F.concat(F.lit(CORRELATION_TEXT), number_text("correlation")))
