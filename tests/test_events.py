"""Click-to-impression matching and the user-day rollup against a plain
Python nested loop, including NULL keys, duplicate clicks and hot copies."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from liftlens.constants import SERVE_KEYS
from liftlens.operators import events
from liftlens.params import Params
from liftlens.sources.schemas import DELIVERY_LOG

P = Params(dt.date(2020, 1, 1), dt.date(2020, 1, 3), (1, 2), ("m",))


def _row(rng, hot=None):
    if hot is not None:
        return dict(hot)
    xid = rng.choice(["u1", "u2", "u3", None])
    return {
        "logdate": dt.date(2020, 1, rng.randint(1, 4)),
        "OrderId": rng.choice([1, 2, 3]),
        "LineItemId": rng.randint(0, 1),
        "CreativeId": rng.randint(0, 1),
        "CreativeVersion": 1,
        "CreativeSize": rng.choice(["a", "b"]),
        "AdUnitId": rng.randint(0, 1),
        "CityId": rng.choice([1, None]),
        "Time": dt.datetime(2020, 1, 1, rng.randint(0, 1)),
        "TimeUsec": rng.randint(0, 1),
        "Product": "p",
        "AdvertiserId": "adv",
        "CustomTargeting": {"vnd_4d_xid": xid} if xid else {"other": "x"},
    }


def _brute(imps, clicks, p):
    def keep(r):
        uid = r["CustomTargeting"].get("vnd_4d_xid")
        ok = r["OrderId"] in p.order_ids and p.start_date <= r["logdate"] <= p.end_date and uid is not None
        if p.line_item_ids:
            ok = ok and r["LineItemId"] in p.line_item_ids
        return ok

    def eq(a, b):
        return a is not None and b is not None and a == b

    fi = [r for r in imps if keep(r)]
    fc = [r for r in clicks if keep(r)]
    out = defaultdict(lambda: [0, 0])
    for i in fi:
        ix = i["CustomTargeting"]["vnd_4d_xid"]
        hits = [
            c for c in fc
            if eq(ix, c["CustomTargeting"]["vnd_4d_xid"]) and all(eq(i[k], c[k]) for k in SERVE_KEYS)
        ]
        key = (ix, i["logdate"])
        if hits:
            out[key][0] += len(hits)
            out[key][1] += len(hits)
        else:
            out[key][0] += 1
    return {k: tuple(v) for k, v in out.items()}


def _spark(spark, imps, clicks, p):
    i = spark.createDataFrame(imps, DELIVERY_LOG)
    c = spark.createDataFrame(clicks, DELIVERY_LOG)
    rows = events.user_days(i, c, p).collect()
    return {(r.xid_imp, r.date): (r.impressions, r.clicks) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_rollup_matches_nested_loop(spark, seed):
    rng = random.Random(seed)
    imps = [_row(rng) for _ in range(120)]
    clicks = [_row(rng) for _ in range(60)] + imps[:10] + imps[:3]  # exact copies -> fan-out
    assert _spark(spark, imps, clicks, P) == _brute(imps, clicks, P)


def test_line_item_filter(spark):
    rng = random.Random(7)
    imps = [_row(rng) for _ in range(100)]
    clicks = imps[::3] + imps[::5]
    p = P.with_line_items((1,))
    assert _spark(spark, imps, clicks, p) == _brute(imps, clicks, p)


def test_hot_copies_collapse_exactly(spark):
    """A third of all rows are copies of one serve, clicked twice."""
    rng = random.Random(11)
    base = [_row(rng) for _ in range(80)]
    hot = next(r for r in base if r["CustomTargeting"].get("vnd_4d_xid") and r["OrderId"] in (1, 2)
               and r["logdate"] <= dt.date(2020, 1, 3) and r["CityId"] is not None)
    imps = base + [_row(rng, hot) for _ in range(40)]
    clicks = [dict(hot), dict(hot)] + base[:20]
    got = _spark(spark, imps, clicks, P)
    assert got == _brute(imps, clicks, P)


def test_null_key_never_matches(spark):
    rng = random.Random(3)
    r = _row(rng)
    r.update(CityId=None, OrderId=1, logdate=dt.date(2020, 1, 1), CustomTargeting={"vnd_4d_xid": "u9"})
    got = _spark(spark, [r], [dict(r)], P)
    assert got == {("u9", dt.date(2020, 1, 1)): (1, 0)}


def test_filters_reach_the_scan(spark, tmp_path):
    """On a log stored like production (Parquet partitioned by logdate) the
    order filter is pushed into the scan and the date window prunes folders."""
    from liftlens.sources.standins import standin_tables

    t = standin_tables(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "imps")
    t.impressions.drop("flag").write.partitionBy("logdate").parquet(path)
    imps = spark.read.parquet(path)
    plan = events.impressions_filtered(imps, P)._jdf.queryExecution().executedPlan().toString()
    assert "In(OrderId" in plan or "InSet(OrderId" in plan
    assert "PartitionFilters: [isnotnull(logdate" in plan


def test_long_id_lists_use_a_semi_join(spark):
    rng = random.Random(5)
    imps = [_row(rng) for _ in range(60)]
    df = spark.createDataFrame(imps, DELIVERY_LOG)
    inline = events.filter_log(df, P)
    semi = events.filter_log(df, P, inline_limit=1)
    assert sorted(map(str, inline.collect())) == sorted(map(str, semi.collect()))
    plan = semi._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Broadcast" in plan


def test_window_compares_dates_for_timestamp_and_text_columns(spark):
    from pyspark.sql import functions as F

    from liftlens.functions.columns import in_window

    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 3, 23, 59), "2020-1-3"), (dt.datetime(2020, 1, 4, 0, 0), "2020-01-04")],
        "ts timestamp_ntz, txt string",
    )
    assert df.filter(in_window("ts", P)).count() == 1  # the whole last day is inside
    assert df.filter(in_window("txt", P)).count() == 1  # unpadded text compares as a date
    assert df.filter(F.col("txt").between("2020-01-01", "2020-01-03")).count() == 0  # the text trap



def test_another_targeting_key(spark):
    rng = random.Random(5)
    imps = [_row(rng) for _ in range(60)]
    for r in imps:
        r["CustomTargeting"] = {"own_key": "u1", **{k: "other" for k in r["CustomTargeting"]}}
    frame = spark.createDataFrame(imps, DELIVERY_LOG)
    p = Params(P.start_date, P.end_date, P.order_ids, P.models, user_key="own_key")
    got = events.user_days(frame, frame, p).collect()
    assert got and {r.xid_imp for r in got} == {"u1"}


@pytest.mark.parametrize("together", ["AdUnitId", "CityId", "Time"])
def test_logs_that_lie_together_give_the_same_rollup(spark, together):
    rng = random.Random(13)
    imps = [_row(rng) for _ in range(120)]
    clicks = [_row(rng) for _ in range(60)] + imps[:10] + imps[:3]
    i = events.impressions_filtered(spark.createDataFrame(imps, DELIVERY_LOG), P)
    c = events.clicks_filtered(spark.createDataFrame(clicks, DELIVERY_LOG), P)
    for words in (1, 1 << 14):
        rows = events.rollup_user_day(i, c, words, together).collect()
        assert {(r.xid_imp, r.date): (r.impressions, r.clicks) for r in rows} == _brute(imps, clicks, P)


def test_only_a_serve_key_can_hold_logs_together(spark):
    none = spark.createDataFrame([], DELIVERY_LOG)
    with pytest.raises(ValueError):
        events.rollup_user_day(events.impressions_filtered(none, P), events.clicks_filtered(none, P), together="xid")
