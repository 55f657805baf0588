"""Notebook-named entry points give the registered queries' results."""

import datetime as dt

from liftlens import compat
from liftlens.plans.queries import DEFAULT_PARAMS as P, QUERIES
from liftlens.sources.standins import standin_tables
from tests.conftest import SF0001


def test_notebook_flow_matches_registry(spark):
    t = standin_tables(spark, SF0001)
    ci = compat.match_clicks_impressions(t.impressions, t.clicks, "0,1,2," + ",".join(map(str, range(3, 100))),
                                         "1995-01-01", dt.date(2001, 12, 31))
    assert sorted(ci.collect()) == sorted(QUERIES["clicks_impressions_by_user_day"](spark, SF0001).collect())
    d1 = compat.match_ctr_by_decile(t.scores, P.start_date, P.end_date, P.model1, ci)
    assert sorted(d1.collect(), key=str) == sorted(QUERIES["ctr_by_decile"](spark, SF0001).collect(), key=str)
    b1 = compat.group_ctr_decile_groups(d1)
    assert sorted(b1.collect(), key=str) == sorted(QUERIES["ctr_by_band"](spark, SF0001).collect(), key=str)
    b2 = compat.group_ctr_decile_groups(compat.match_ctr_by_decile(t.scores, P.start_date, P.end_date, P.model2, ci))
    z = compat.compare_bands(b1, b2).collect()[0]
    ref = QUERIES["z_test_high_band"](spark, SF0001).collect()[0]
    assert round(z.z, 9) == ref.z and round(z.p_value, 9) == ref.p_value
    cells, bands, corr = compat.compare_two_models(t.scores, P.model1, P.model2, P.start_date, P.end_date)
    assert sorted(cells.collect(), key=str) == sorted(QUERIES["overlap_by_decile"](spark, SF0001).collect(), key=str)
    assert sorted(bands.collect(), key=str) == sorted(QUERIES["overlap_by_band"](spark, SF0001).collect(), key=str)
    counts = compat.calculate_p_value(spark, ref.clicks_1, ref.clicks_2, ref.impressions_1, ref.impressions_2).collect()[0]
    assert round(counts.p_value, 9) == ref.p_value and counts.verdict == ref.verdict
    assert counts.p_value_text == f"The calculated p_value is: {counts.p_value}" and counts.alpha_text == "alpha is: 0.05"
    assert round(corr.collect()[0].correlation, 9) == QUERIES["score_correlation"](spark, SF0001).collect()[0].correlation


def test_repeated_user_days_are_summed(spark):
    days = spark.createDataFrame([("u", dt.date(2020, 1, 1), 10, 1), ("u", dt.date(2020, 1, 1), 5, 2)], "xid_imp string, date date, impressions long, clicks long")
    scores = spark.createDataFrame([("u", dt.date(2020, 1, 1), "a", 0.5, 3)], "xid string, date date, tid string, score double, decile int")
    got = compat.match_ctr_by_decile(scores, dt.date(2020, 1, 1), dt.date(2020, 1, 2), "a", days).collect()
    assert [(r.tid, r.decile, r.impressions, r.clicks) for r in got] == [("a", 3, 15, 3)]


def test_model_ids_compare_as_values_of_their_column(spark):
    days = spark.createDataFrame([("u", dt.date(2020, 1, 1), 10, 1)], "xid_imp string, date date, impressions long, clicks long")
    scores = spark.createDataFrame([("u", dt.date(2020, 1, 1), 7, 0.5, 3)], "xid string, date date, tid long, score double, decile int")
    got = compat.match_ctr_by_decile(scores, dt.date(2020, 1, 1), dt.date(2020, 1, 2), "07", days).collect()
    assert [(r.tid, r.decile, r.impressions, r.clicks) for r in got] == [(7, 3, 10, 1)]
