"""Dimension lookups: campaign (order) names and model segment names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.constants import MODEL_TITLE_PREFIX, ORDER_NAME_COLUMN


def order_names(line_items: DataFrame, order_ids) -> DataFrame:
    """``orderId, Orders_Analyzed``: per requested id (duplicates repeat, in
    input order) the name of its earliest-created line item; a NULL creation
    time sorts first and ties take the smallest name. Unknown ids give a NULL
    name.

    The earliest row is a ``min`` over a struct, so it aggregates map-side: an
    order with a third of all line items never lands whole in one task.
    """
    spark = line_items.sparkSession
    ids = list(order_ids)
    first = (
        line_items.filter(F.col("orderId").isin(ids))
        .groupBy("orderId")
        .agg(
            F.min(
                F.struct(
                    F.col("creationDateTime").isNotNull().alias("has_time"),
                    F.col("creationDateTime").alias("t"),
                    F.col("orderName").alias("name"),
                )
            ).alias("first")
        )
    )
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, orderId bigint")
    # ``first`` holds at most one row per requested id: bounded by the input list.
    return (
        wanted.join(F.broadcast(first), "orderId", "left")
        .select("pos", "orderId", F.col("first.name").alias(ORDER_NAME_COLUMN))
        .coalesce(1)  # one row per requested id: a single sorted partition suffices
        .sortWithinPartitions("pos")
        .drop("pos")
    )


def segment_names(segment_trait: DataFrame, models) -> DataFrame:
    """``model_no, trait_id, segment_name, title`` per model (1-based position);
    several names for one id resolve to the smallest."""
    spark = segment_trait.sparkSession
    models = list(models)
    names = (
        segment_trait.filter(F.col("trait_id").isin(models))
        .groupBy("trait_id")
        .agg(F.min("segment_name").alias("segment_name"))
    )
    wanted = spark.createDataFrame([(i + 1, m) for i, m in enumerate(models)], "model_no int, trait_id string")
    return wanted.join(F.broadcast(names), "trait_id", "left").select(
        "model_no",
        "trait_id",
        "segment_name",
        F.concat(F.lit(MODEL_TITLE_PREFIX), F.col("model_no").cast("string"), F.lit(": "), F.col("segment_name")).alias(
            "title"
        ),
    )


def scores_preview(scores: DataFrame, n: int = 100, ordered: bool = True) -> DataFrame:
    """``n`` score rows for a look at the table; the limit is the feature.

    ``ordered=True`` gives the first rows by every column: deterministic,
    planned as a per-task top-n plus a merge, but it reads the whole table.
    ``ordered=False`` takes any ``n`` rows, as a notebook display does: the
    scan stops after the first splits, so it stays cheap on a huge table.
    """
    if not ordered:
        return scores.limit(n)
    return scores.orderBy(*[F.col(c).asc_nulls_first() for c in scores.columns]).limit(n)
