"""Property tests: generated small logs and score tables (collisions, NULL
keys, copies) against plain-Python brute force."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from liftlens.operators import events, lift
from liftlens.params import Params
from liftlens.sources.schemas import DELIVERY_LOG
from tests.test_events import _brute as brute_rollup
from tests.test_lift import SC_SCHEMA, UD_SCHEMA
from tests.test_lift import _brute as brute_deciles

P = Params(dt.date(2020, 1, 1), dt.date(2020, 1, 3), (1, 2), ("a", "b"))

log_row = st.fixed_dictionaries(
    {
        "logdate": st.dates(dt.date(2020, 1, 1), dt.date(2020, 1, 4)),
        "OrderId": st.sampled_from([1, 2, 3]),
        "LineItemId": st.just(0),
        "CreativeId": st.sampled_from([0, 1]),
        "CreativeVersion": st.just(1),
        "CreativeSize": st.sampled_from(["a", "b"]),
        "AdUnitId": st.just(0),
        "CityId": st.sampled_from([1, None]),
        "Time": st.just(dt.datetime(2020, 1, 1, 12)),
        "TimeUsec": st.sampled_from([0, 1]),
        "Product": st.just("p"),
        "AdvertiserId": st.just("adv"),
        "CustomTargeting": st.sampled_from([{"vnd_4d_xid": "u1"}, {"vnd_4d_xid": "u2"}, {"other": "x"}]),
    }
)

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(imps=st.lists(log_row, min_size=1, max_size=25), clicks=st.lists(log_row, max_size=15),
       copies=st.integers(0, 3))
def test_rollup_property(spark, imps, clicks, copies):
    clicks = clicks + imps[:1] * copies  # repeated clicks on one impression
    i = spark.createDataFrame(imps, DELIVERY_LOG)
    c = spark.createDataFrame(clicks, DELIVERY_LOG) if clicks else spark.createDataFrame([], DELIVERY_LOG)
    got = {(r.xid_imp, r.date): (r.impressions, r.clicks) for r in events.user_days(i, c, P).collect()}
    assert got == brute_rollup(imps, clicks, P)


ud_row = st.tuples(st.sampled_from(["u1", "u2", "u3"]), st.dates(dt.date(2020, 1, 1), dt.date(2020, 1, 2)),
                   st.integers(1, 5), st.integers(0, 2))
score_row = st.tuples(st.sampled_from(["u1", "u2", "u4"]), st.dates(dt.date(2020, 1, 1), dt.date(2020, 1, 3)),
                      st.sampled_from(["a", "b", "c"]), st.sampled_from([0.1, 0.2, None]),
                      st.sampled_from([1, 5, 10, None]))


@SETTINGS
@given(uds=st.lists(ud_row, min_size=1, max_size=8, unique_by=lambda r: (r[0], r[1])),
       scores=st.lists(score_row, max_size=20))
def test_decile_property(spark, uds, scores):
    ud = spark.createDataFrame(uds, UD_SCHEMA)
    sc = spark.createDataFrame(scores, SC_SCHEMA)
    p = Params(dt.date(2020, 1, 1), dt.date(2020, 1, 2), (1,), ("a", "b"))
    got = lift.ctr_by_decile(ud, lift.prepare_scores(sc, p), p.models).collect()
    for m in p.models:
        mine = {(r.tid, r.decile): (r.impressions, r.clicks) for r in got if r.model == m}
        assert mine == brute_deciles(uds, scores, m)


overlap_row = st.tuples(st.sampled_from(["u1", "u2", "u3", "u4"]), st.dates(dt.date(2020, 1, 1), dt.date(2020, 1, 3)),
                        st.sampled_from(["a", "b", "c"]), st.sampled_from([0.1, 0.7, None]),
                        st.sampled_from([1, 4, 9, None]))


@SETTINGS
@given(scores=st.lists(overlap_row, max_size=30))
def test_overlap_pairs_property(spark, scores):
    from liftlens.operators import overlap
    from tests.test_overlap import _join_formulation

    p = Params(dt.date(2020, 1, 1), dt.date(2020, 1, 2), (1,), ("a", "b"))
    sc = spark.createDataFrame(scores, SC_SCHEMA)
    got = sorted(map(str, overlap.best_score_pairs(sc, p, "a", "b").collect()))
    cols = ["xid", "tid1Decile", "tid1Score", "tid2Decile", "tid2Score"]
    want = sorted(map(str, _join_formulation(sc, p).select(*cols).collect()))
    assert got == want
