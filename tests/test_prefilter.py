"""The Bloom filter of fixed size: no listed key is missed, its table is bounded."""

import pytest
from pyspark.sql import functions as F

from liftlens.operators.prefilter import MAX_FILTER_WORDS, key_filter, mark_listed


def _keys(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("t"))


@pytest.mark.parametrize("words", [1, 64, 1 << 12])
def test_listed_keys_are_never_missed(spark, words):
    keys = _keys(spark, 500)
    rows = _keys(spark, 5000).withColumnRenamed("t", "u").withColumn("listed", F.lit("own"))
    marked = mark_listed(rows, keys, ["k", "u"], "hit", words)
    assert marked.columns == ["k", "u", "listed", "hit"] and marked.count() == 5000
    assert marked.filter("k < 500 and not hit").count() == 0
    others = marked.filter("k >= 500 and hit").count()
    assert others < 50 if words == 1 << 12 else others <= 4500
    assert key_filter(keys, words).count() <= words


def test_null_keys_and_empty_filters(spark):
    keys = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k long, t string")
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, None), (3, "b")], "k long, t string")
    got = {(r.k, r.t): r.hit for r in mark_listed(rows, keys, ["k", "t"], "hit").collect()}
    assert got[(1, "a")] and not got[(2, None)] and not got[(None, None)]
    assert mark_listed(rows, keys.limit(0), ["k", "t"], "hit").filter("hit").count() == 0


@pytest.mark.parametrize("words", [0, 3, 2 * MAX_FILTER_WORDS])
def test_sizes_are_checked(spark, words):
    with pytest.raises(ValueError):
        key_filter(_keys(spark, 1), words)


def test_rollup_is_the_same_at_any_filter_size(spark):
    from liftlens.operators import events
    from liftlens.plans.queries import FIXTURE_PARAMS as P
    from liftlens.sources.standins import standin_tables
    from tests.conftest import SF0001

    t = standin_tables(spark, SF0001)
    imps, clicks = events.impressions_filtered(t.impressions, P), events.clicks_filtered(t.clicks, P)
    one, many = (sorted(events.rollup_user_day(imps, clicks, words).collect()) for words in (1, 1 << 14))
    assert one == many and one
    # with a filter that fits, impressions without a click have no serve
    counts = [events.serve_counts(imps, clicks, w).filter("keyed and n_imps > 0").count() for w in (1, 1 << 14)]
    assert counts[1] < counts[0]
