"""Two-proportion z-test between the high bands of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.constants import ALPHA_TEXT, BAND_HIGH, P_VALUE_TEXT
from liftlens.functions.labels import number_text
from liftlens.functions.stats import two_proportion_z, two_sided_p_value, verdict


def band_z_test(band_frame: DataFrame, model1: str, model2: str, alpha: float, band_label: str = BAND_HIGH) -> DataFrame:
    """One row: clicks and impressions of ``band_label`` for each model, the
    pooled z statistic, its two-sided p-value, ``alpha``, ``significant`` and the
    verdict sentence. A missing band row gives NULL counts, NULL z and p and a
    "not rejected" verdict.

    The band frame has a handful of rows, so the pivot is one global
    aggregate over it (no join).
    """
    h = band_frame.filter((F.col("DecileGroup") == band_label) & F.col("tid").isNotNull())

    def pick(model: str, c: str):
        return F.sum(F.when(F.col("model") == model, F.col(c)))

    counts = h.agg(
        pick(model1, "clicks").alias("clicks_1"),
        pick(model1, "impressions").alias("impressions_1"),
        pick(model2, "clicks").alias("clicks_2"),
        pick(model2, "impressions").alias("impressions_2"),
    )
    z = counts.select(
        F.lit(model1).alias("model_1"),
        F.lit(model2).alias("model_2"),
        "*",
        two_proportion_z("clicks_1", "impressions_1", "clicks_2", "impressions_2").alias("z"),
        F.lit(float(alpha)).alias("alpha"),
    )
    p = z.withColumn("p_value", two_sided_p_value("z"))
    return p.select(
        "*",
        F.coalesce(F.col("p_value") < F.col("alpha"), F.lit(False)).alias("significant"),
        verdict("p_value", "alpha").alias("verdict"),
    )


def with_sentences(result: DataFrame) -> DataFrame:
    """Adds the report's sentences about ``p_value`` and ``alpha``."""
    return result.withColumns(
        {
            "p_value_text": F.concat(F.lit(P_VALUE_TEXT), number_text("p_value")),
            "alpha_text": F.concat(F.lit(ALPHA_TEXT), number_text("alpha")),
        }
    )
