"""Two-proportion z-test and correlation."""

import math

import pytest
from pyspark.sql import functions as F

from liftlens.constants import VERDICT_NOT_REJECTED, VERDICT_REJECTED
from liftlens.functions.stats import pearson
from liftlens.operators.significance import band_z_test

SCHEMA = "model string, tid string, DecileGroup string, impressions bigint, clicks bigint"


def _expected(c1, n1, c2, n2):
    p = (c1 + c2) / (n1 + n2)
    z = (c1 / n1 - c2 / n2) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return z, math.erfc(abs(z) / math.sqrt(2))


def _bands(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_z_and_p_match_formula(spark):
    rows = [("a", "a", "1. H", 1196, 378), ("b", "b", "1. H", 1136, 373), ("a", "a", "2. M", 10, 1)]
    r = band_z_test(_bands(spark, rows), "a", "b", 0.05).collect()[0]
    z, p = _expected(378, 1196, 373, 1136)
    assert r.z == pytest.approx(z, abs=1e-12)
    assert r.p_value == pytest.approx(p, abs=1e-12)
    assert r.verdict == VERDICT_NOT_REJECTED and r.significant is False


def test_z_is_antisymmetric(spark):
    rows = [("a", "a", "1. H", 500, 90), ("b", "b", "1. H", 400, 40)]
    ab = band_z_test(_bands(spark, rows), "a", "b", 0.05).collect()[0]
    ba = band_z_test(_bands(spark, rows), "b", "a", 0.05).collect()[0]
    assert ab.z == pytest.approx(-ba.z)
    assert ab.p_value == pytest.approx(ba.p_value)
    assert ab.verdict == VERDICT_REJECTED and ab.significant is True


@pytest.mark.parametrize(
    "rows",
    [
        [("a", "a", "1. H", 100, 0), ("b", "b", "1. H", 50, 0)],  # pooled rate 0
        [("a", "a", "1. H", 100, 100), ("b", "b", "1. H", 50, 50)],  # pooled rate 1
        [("a", "a", "2. M", 100, 10), ("b", "b", "1. H", 50, 5)],  # no H row for a
        [],
    ],
)
def test_undefined_z_does_not_reject(spark, rows):
    r = band_z_test(_bands(spark, rows), "a", "b", 0.05).collect()[0]
    assert r.z is None and r.p_value is None
    assert r.verdict == VERDICT_NOT_REJECTED and r.significant is False


def test_unscored_band_row_is_ignored(spark):
    rows = [("a", None, "1. H", 999, 999), ("a", "a", "1. H", 100, 10), ("b", "b", "1. H", 100, 20)]
    r = band_z_test(_bands(spark, rows), "a", "b", 0.05).collect()[0]
    assert (r.clicks_1, r.impressions_1) == (10, 100)


def test_pearson_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.5)], "x double, y double")
    got = df.agg(pearson("x", "y").alias("r")).collect()[0].r
    import numpy as np

    assert got == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5.5])[0, 1], abs=1e-12)
    const = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert const.agg(pearson("x", "y").alias("r")).collect()[0].r is None
    assert df.limit(1).agg(pearson("x", "y").alias("r")).collect()[0].r is None
    assert df.filter(F.lit(False)).agg(pearson("x", "y").alias("r")).collect()[0].r is None


def test_erfc_matches_math_erfc(spark):
    from liftlens.functions.stats import erfc

    xs = [i / 40 for i in range(0, 241)] + [2.4999, 2.5, 2.5001, 8.0, 10.0, 26.0, 30.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc("x").alias("e")).collect()
    for r in rows:
        ref = math.erfc(r.x)
        assert r.e == pytest.approx(ref, rel=1e-12, abs=1e-300), r.x
