"""Registered queries over the stand-in inputs: one per operator of the
dashboard, each ``(spark, sf_dir) -> DataFrame`` with the default parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.operators.overlap import with_sentence
from liftlens.operators.significance import with_sentences
from liftlens.params import Params
from liftlens.plans.dashboard import Dashboard, single_model
from liftlens.sources.standins import standin_tables

# Parameters of the registered queries: every order id the stand-in logs carry
# (OrderId is l_suppkey % 100) and a window spanning all their dates, so each
# registered query runs over the whole tables.
DEFAULT_PARAMS = Params(
    start_date=dt.date(1995, 1, 1),
    end_date=dt.date(2001, 12, 31),
    order_ids=tuple(range(100)),
    models=("1-URGENT", "5-LOW"),
    alpha=0.05,
)
# The optional line-item filter is exercised by its own variant queries.
LINE_ITEM_IDS = (0, 1, 2, 3, 4)

# Every model id the stand-in scores carry, for the all-models variants.
ALL_MODELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# A narrower campaign (60 order ids, four years) whose results are pinned as
# golden numbers in the tests.
FIXTURE_PARAMS = Params(
    start_date=dt.date(1996, 1, 1),
    end_date=dt.date(1999, 12, 31),
    order_ids=tuple(range(60)),
    models=("1-URGENT", "5-LOW"),
    alpha=0.05,
)

# Display precision of test statistics (z, p-value, correlation).
STAT_DIGITS = 9


def dashboard(spark: SparkSession, sf_dir: str, params: Params = DEFAULT_PARAMS) -> Dashboard:
    return Dashboard(standin_tables(spark, sf_dir), params)


def _d(spark, sf_dir, params=DEFAULT_PARAMS) -> Dashboard:
    return dashboard(spark, sf_dir, params)


def _materialized(spark, sf_dir) -> Dashboard:
    return dashboard(spark, sf_dir).materialize()


def _line_items() -> Params:
    return DEFAULT_PARAMS.with_line_items(LINE_ITEM_IDS)


def _all_models() -> Params:
    p = DEFAULT_PARAMS
    return Params(p.start_date, p.end_date, p.order_ids, ALL_MODELS, p.line_item_ids, p.alpha)


def _z_test(d: Dashboard) -> DataFrame:
    return d.z_test_high_band().withColumn("z", F.round("z", STAT_DIGITS)).withColumn(
        "p_value", F.round("p_value", STAT_DIGITS)
    )


def _correlation(d: Dashboard) -> DataFrame:
    return d.score_correlation().withColumn("correlation", F.round("correlation", STAT_DIGITS))


def _state(d: Dashboard) -> DataFrame:
    """The state with deviations and the product (in millions) per user, at display precision."""
    shown = {
        "mean1": F.round("mean1", 4),
        "mean2": F.round("mean2", 4),
        "deviation1": F.round(F.sqrt(F.col("square1") / F.col("count")), 3),
        "deviation2": F.round(F.sqrt(F.col("square2") / F.col("count")), 3),
        "covariance": F.round(F.col("product") / F.col("count") / 1e6, 3),
    }
    as_is = ("tid1Decile", "tid2Decile", "count", "least1", "most1", "least2", "most2")
    return d.overlap_state.select(*as_is, *(c.alias(k) for k, c in shown.items()))


def _m1(frame: DataFrame) -> DataFrame:
    return single_model(frame, DEFAULT_PARAMS.model1)


def _m2(frame: DataFrame) -> DataFrame:
    return single_model(frame, DEFAULT_PARAMS.model2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "impressions_filtered": lambda s, d: _d(s, d).impressions(),
    "impressions_line_items": lambda s, d: _d(s, d, _line_items()).impressions(),
    "clicks_filtered": lambda s, d: _d(s, d).clicks(),
    "clicks_impressions_by_user_day": lambda s, d: _d(s, d).user_days,
    "clicks_impressions_by_user_day_line_items": lambda s, d: _d(s, d, _line_items()).user_days,
    # The narrower campaign: its order ids and days leave rows out, which is
    # the feature, so these fail if an order or date filter is lost.
    "impressions_filtered_campaign": lambda s, d: _d(s, d, FIXTURE_PARAMS).impressions(),
    "clicks_filtered_campaign": lambda s, d: _d(s, d, FIXTURE_PARAMS).clicks(),
    "clicks_impressions_by_user_day_campaign": lambda s, d: _d(s, d, FIXTURE_PARAMS).user_days,
    "ctr_by_decile_models_campaign": lambda s, d: _d(s, d, FIXTURE_PARAMS).ctr_by_decile(),
    "user_best_scores_campaign": lambda s, d: _d(s, d, FIXTURE_PARAMS).user_best_scores(),
    "order_names_campaign": lambda s, d: _d(s, d, FIXTURE_PARAMS).order_names(),
    "order_names": lambda s, d: _d(s, d).order_names(),
    "segment_names": lambda s, d: _d(s, d).segment_names(),
    "scores_preview": lambda s, d: _d(s, d).scores_preview(),
    "scores_dedup": lambda s, d: _d(s, d).scores_dedup(),
    "ctr_by_decile": lambda s, d: _m1(_d(s, d).ctr_by_decile([DEFAULT_PARAMS.model1])),
    "ctr_by_decile_model2": lambda s, d: _m2(_d(s, d).ctr_by_decile([DEFAULT_PARAMS.model2])),
    "ctr_by_decile_models": lambda s, d: _d(s, d).ctr_by_decile(),
    # From the bucketed rollup table, with the scores of unexposed users left out at their scan.
    "ctr_by_decile_models_materialized": lambda s, d: _materialized(s, d).ctr_by_decile(fresh=True),
    "ctr_by_decile_all_models": lambda s, d: _d(s, d, _all_models()).ctr_by_decile(),
    "ctr_by_band_all_models": lambda s, d: _d(s, d, _all_models()).ctr_by_band(),
    "ctr_by_decile_dense": lambda s, d: _d(s, d).ctr_by_decile_dense(),
    "ctr_by_decile_report": lambda s, d: _d(s, d).ctr_by_decile_report(),
    "ctr_by_band": lambda s, d: _m1(_d(s, d).ctr_by_band([DEFAULT_PARAMS.model1])),
    "ctr_by_band_model2": lambda s, d: _m2(_d(s, d).ctr_by_band([DEFAULT_PARAMS.model2])),
    "ctr_by_band_models": lambda s, d: _d(s, d).ctr_by_band(),
    "ctr_by_band_dense": lambda s, d: _d(s, d).ctr_by_band_dense(),
    "ctr_by_band_report": lambda s, d: _d(s, d).ctr_by_band_report(),
    "z_test_high_band": lambda s, d: _z_test(_d(s, d)),
    "user_best_scores": lambda s, d: _d(s, d).user_best_scores(),
    "overlap_by_decile": lambda s, d: _d(s, d).overlap_by_decile(),
    "overlap_by_band": lambda s, d: _d(s, d).overlap_by_band(),
    "overlap_decile_matrix": lambda s, d: _d(s, d).overlap_decile_matrix(),
    "overlap_band_matrix": lambda s, d: _d(s, d).overlap_band_matrix(),
    "overlap_decile_wide": lambda s, d: _d(s, d).overlap_decile_wide(),
    "score_correlation": lambda s, d: _correlation(_d(s, d)),
    # The sentences of the report, from values of the registered precision.
    "z_test_sentences": lambda s, d: with_sentences(_z_test(_d(s, d))).select("p_value_text", "alpha_text", "verdict"),
    "score_correlation_sentence": lambda s, d: with_sentence(_correlation(_d(s, d))).select("correlation_text"),
    "overlap_state": lambda s, d: _state(_d(s, d)),
}
