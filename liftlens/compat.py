"""The dashboard's own entry points, by name, over DataFrames.

For users moving from the notebook: each function keeps the notebook's name and
argument order after the input frames, takes frames instead of catalog names (see
:func:`liftlens.sources.read_catalog`) and returns a lazy DataFrame instead of
displaying or collecting. Drawing functions have no counterpart; their data is
the dense and matrix frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.operators import events, lift, overlap, significance
from liftlens.functions.stats import two_proportion_z, two_sided_p_value, verdict
from liftlens.operators.significance import with_sentences
from liftlens.params import Params, parse_id_list
from liftlens.plans.dashboard import single_model


def _params(order_ids, start_date, end_date, models=(), line_item_ids=()) -> Params:
    if isinstance(order_ids, str):
        order_ids = parse_id_list(order_ids, required=True)
    if isinstance(line_item_ids, str):
        line_item_ids = parse_id_list(line_item_ids, required=False)
    return Params(start_date, end_date, tuple(order_ids), tuple(models), tuple(line_item_ids or ()))


def match_clicks_impressions(
    impressions: DataFrame, clicks: DataFrame, order_ids, start_date, end_date, line_item_ids=()
) -> DataFrame:
    """``xid_imp, date, impressions, clicks`` per user-day of the campaign."""
    return events.user_days(impressions, clicks, _params(order_ids, start_date, end_date, line_item_ids=line_item_ids))


def match_ctr_by_decile(scores: DataFrame, start_date, end_date, model_tid: str, clicks_and_impressions: DataFrame) -> DataFrame:
    """``tid, decile, impressions, clicks, ctr`` for one model, unscored row included."""
    p = _params((0,), start_date, end_date, (model_tid,))
    frame = lift.ctr_by_decile(clicks_and_impressions, lift.prepare_scores(scores, p), [model_tid])
    return single_model(frame, model_tid)


def group_ctr_decile_groups(ctr_by_decile: DataFrame) -> DataFrame:
    """``tid, DecileGroup, impressions, clicks, ctr`` from a decile frame."""
    has_model = "model" in ctr_by_decile.columns
    frame = ctr_by_decile if has_model else ctr_by_decile.withColumn("model", ctr_by_decile["tid"])
    out = lift.ctr_by_band(frame)
    return out if has_model else out.drop("model")


def calculate_p_value(spark: SparkSession, counts1: int, counts2: int, nobs1: int, nobs2: int, alpha: float = 0.05) -> DataFrame:
    """One-row z-test of two click counts out of two impression counts."""
    frame = spark.createDataFrame([(counts1, counts2, nobs1, nobs2)], "c1 long, c2 long, n1 long, n2 long")
    z = frame.select(two_proportion_z("c1", "n1", "c2", "n2").alias("z"), F.lit(float(alpha)).alias("alpha"))
    return with_sentences(z.withColumn("p_value", two_sided_p_value("z")).withColumn("verdict", verdict("p_value", "alpha")))


def compare_bands(band_model1: DataFrame, band_model2: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One-row z-test of the H bands of two band frames (each one model's
    :func:`group_ctr_decile_groups` output). The notebook passes four counts: see
    :func:`calculate_p_value`."""

    def tagged(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(F.lit(tag).alias("model"), "tid", "DecileGroup", "impressions", "clicks")

    both = tagged(band_model1, "model 1").unionByName(tagged(band_model2, "model 2"))
    return significance.band_z_test(both, "model 1", "model 2", alpha)


def compare_two_models(scores: DataFrame, model1_tid: str, model2_tid: str, start_date, end_date):
    """``(overlap by decile, overlap by band, correlation)`` frames."""
    p = _params((0,), start_date, end_date, (model1_tid, model2_tid))
    pairs = overlap.best_score_pairs(scores, p, model1_tid, model2_tid)
    state = overlap.overlap_state(pairs)
    cells = overlap.overlap_by_decile(state)
    return cells, overlap.overlap_by_band(cells), overlap.score_correlation(state)
