"""Score attachment, decile/band CTR, dense forms and their invariants."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from liftlens.functions.columns import band
from liftlens.operators import lift
from liftlens.params import Params

D1 = dt.date(2020, 1, 1)
P = Params(D1, dt.date(2020, 1, 2), (1,), ("a", "b"))
UD_SCHEMA = "xid_imp string, date date, impressions bigint, clicks bigint"
SC_SCHEMA = "xid string, date date, tid string, score double, decile int"


def test_band_edges(spark):
    df = spark.createDataFrame([(0,), (3,), (4,), (7,), (8,), (11,), (None,)], "d int")
    got = [r.b for r in df.select(band("d").alias("b")).collect()]
    assert got == ["1. H", "1. H", "2. M", "2. M", "3. L", "3. L", "Unscored"]


def test_band_gaps_of_fractional_deciles(spark):
    df = spark.createDataFrame([(3.5,), (7.5,), (float("nan"),)], "d double")
    got = [r.b for r in df.select(band("d").alias("b")).collect()]
    assert got == ["Unscored", "Unscored", "3. L"]


def _random_case(seed):
    rng = random.Random(seed)
    ud = {}
    for _ in range(40):
        ud[(f"u{rng.randint(0, 15)}", dt.date(2020, 1, rng.randint(1, 2)))] = None
    uds = [(x, d, rng.randint(1, 9), rng.randint(0, 3)) for (x, d) in ud]
    scores = []
    for _ in range(50):
        scores.append((f"u{rng.randint(0, 15)}", dt.date(2020, 1, rng.randint(1, 3)), rng.choice(["a", "b", "c"]),
                       rng.choice([0.1, 0.5, None]), rng.choice([1, 2, 5, 9, 10, None])))
    scores += scores[:8]  # exact copies
    return uds, scores


def _brute(uds, scores, model):
    sd = {s for s in scores if s[2] == model and P.start_date <= s[1] <= P.end_date}
    out = defaultdict(lambda: [0, 0])
    for x, d, i, c in uds:
        hits = [s for s in sd if s[0] == x and s[1] == d]
        if not hits:
            out[(None, None)][0] += i
            out[(None, None)][1] += c
        for s in hits:
            out[(s[2], s[4])][0] += i
            out[(s[2], s[4])][1] += c
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_decile_sums_match_per_model_left_join(spark, seed):
    uds, scores = _random_case(seed)
    ud = spark.createDataFrame(uds, UD_SCHEMA)
    sc = spark.createDataFrame(scores, SC_SCHEMA)
    got = lift.ctr_by_decile(ud, lift.prepare_scores(sc, P), P.models).collect()
    for m in P.models:
        mine = {(r.tid, r.decile): (r.impressions, r.clicks) for r in got if r.model == m}
        assert mine == _brute(uds, scores, m)


def test_unique_scores_re_add_to_user_day_totals(spark):
    uds = [("u1", D1, 5, 1), ("u2", D1, 7, 2), ("u3", D1, 3, 0)]
    scores = [("u1", D1, "a", 0.9, 1), ("u2", D1, "a", 0.2, 9), ("u2", D1, "b", 0.3, 4)]
    ud = spark.createDataFrame(uds, UD_SCHEMA)
    dec = lift.ctr_by_decile(ud, lift.prepare_scores(spark.createDataFrame(scores, SC_SCHEMA), P), P.models)
    tot = {r.model: (r.i, r.c) for r in dec.groupBy("model").agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c")).collect()}
    assert tot == {"a": (15, 3), "b": (15, 3)}
    bands = lift.ctr_by_band(dec)
    btot = {r.model: (r.i, r.c) for r in bands.groupBy("model").agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c")).collect()}
    assert btot == tot


def test_null_decile_with_score_row_is_separate_from_unscored(spark):
    uds = [("u1", D1, 4, 1), ("u2", D1, 6, 3)]
    scores = [("u1", D1, "a", None, None)]
    dec = lift.ctr_by_decile(spark.createDataFrame(uds, UD_SCHEMA),
                             lift.prepare_scores(spark.createDataFrame(scores, SC_SCHEMA), P), ["a"])
    rows = {(r.tid, r.decile): (r.impressions, r.clicks, r.ctr) for r in dec.collect()}
    assert rows == {("a", None): (4, 1, 25.0), (None, None): (6, 3, 50.0)}
    bands = {(r.tid, r.DecileGroup) for r in lift.ctr_by_band(dec).collect()}
    assert bands == {("a", "Unscored"), (None, "Unscored")}


def test_dense_frames_have_fixed_shape_and_zero_fill(spark):
    uds = [("u1", D1, 10, 1)]
    scores = [("u1", D1, "a", 0.9, 2)]
    dec = lift.ctr_by_decile(spark.createDataFrame(uds, UD_SCHEMA),
                             lift.prepare_scores(spark.createDataFrame(scores, SC_SCHEMA), P), P.models)
    dense = lift.ctr_by_decile_dense(dec, P.models).collect()
    assert len(dense) == 20
    by = {(r.model, r.decile): (r.impressions, r.clicks, r.ctr) for r in dense}
    assert by[("a", 2)] == (10, 1, 10.0)
    assert by[("a", 1)] == (0, 0, None)
    assert by[("b", 2)] == (0, 0, None)
    bd = lift.ctr_by_band_dense(lift.ctr_by_band(dec), P.models).collect()
    assert len(bd) == 6
    assert {(r.model, r.DecileGroup): r.impressions for r in bd}[("a", "1. H")] == 10


def test_report_labels(spark):
    uds = [("u1", D1, 1234567, 1)]
    dec = lift.ctr_by_decile(spark.createDataFrame(uds, UD_SCHEMA),
                             lift.prepare_scores(spark.createDataFrame([], SC_SCHEMA), P), ["a"])
    r = lift.ctr_by_decile_report(dec, ["a"]).collect()[0]
    assert r.impressions == "1,234,567" and r["ctr %"] == 0.0


def test_hot_user_day_with_many_distinct_scores(spark):
    """One (user, day) holds most score rows, all distinct: counted per decile
    before the join, the result equals one joined row per score row."""
    uds = [("hot", D1, 3, 1), ("u1", D1, 5, 2)]
    scores = [("hot", D1, "a", float(i), (i % 10) + 1) for i in range(3000)]
    scores += [("hot", D1, "a", float(i), (i % 10) + 1) for i in range(500)]  # copies
    scores += [("u1", D1, "b", 0.5, 3)]
    ud = spark.createDataFrame(uds, UD_SCHEMA)
    sc = spark.createDataFrame(scores, SC_SCHEMA)
    got = lift.ctr_by_decile(ud, lift.prepare_scores(sc, P), P.models).collect()
    for m in P.models:
        mine = {(r.tid, r.decile): (r.impressions, r.clicks) for r in got if r.model == m}
        assert mine == _brute(uds, scores, m)
    hot = {r.decile: r.impressions for r in got if r.model == "a" and r.tid == "a"}
    assert hot == {d: 300 * 3 for d in range(1, 11)}


@pytest.mark.parametrize("seed", range(2))
def test_deciles_without_a_counter(spark, seed):
    """Deciles outside 1 to 10 keep rows of their own, next to regular ones."""
    rng = random.Random(seed)
    uds, scores = _random_case(seed)
    scores += [(f"u{rng.randint(0, 15)}", dt.date(2020, 1, rng.randint(1, 2)), rng.choice(["a", "b"]), rng.random(), rng.choice([0, -3, 11, 400, 2])) for _ in range(40)]
    got = lift.ctr_by_decile(spark.createDataFrame(uds, UD_SCHEMA), lift.prepare_scores(spark.createDataFrame(scores, SC_SCHEMA), P), P.models).collect()
    for m in P.models:
        want = _brute(uds, scores, m)
        assert {(r.tid, r.decile): (r.impressions, r.clicks) for r in got if r.model == m} == want
        assert any(d in (0, -3, 11, 400) for _, d in want)


@pytest.mark.parametrize("words", [1, 2, 1 << 10])
def test_scores_of_unexposed_users_are_left_out(spark, words):
    """Any filter size gives the same report; a large one drops most other users."""
    uds, scores = _random_case(1)
    scores += [(f"other{i}", D1, "a", float(i), 1 + i % 10) for i in range(500)]
    ud, sc = spark.createDataFrame(uds, UD_SCHEMA), spark.createDataFrame(scores, SC_SCHEMA)
    kept = lift.prepare_scores(sc, P, users=ud, filter_words=words)
    for m in P.models:
        got = lift.ctr_by_decile(ud, kept, P.models).collect()
        assert {(r.tid, r.decile): (r.impressions, r.clicks) for r in got if r.model == m} == _brute(uds, scores, m)
    others = kept.filter(F.col("xid").startswith("other")).count()
    assert others <= 5 if words > 2 else others <= 500


def test_one_id_under_two_spellings(spark):
    """Each requested text is compared as a value of the id column."""
    sc = spark.createDataFrame([("u1", D1, 7, 0.5, 3)], "xid string, date date, tid int, score double, decile int")
    ud = spark.createDataFrame([("u1", D1, 4, 1), ("u2", D1, 6, 0)], UD_SCHEMA)
    got = {(r.model, r.tid, r.decile): r.impressions for r in lift.ctr_by_decile(ud, sc, ["7", "07", "x"]).collect()}
    assert got == {("7", 7, 3): 4, ("07", 7, 3): 4, ("7", None, None): 6, ("07", None, None): 6, ("x", None, None): 10}


def test_report_order_follows_the_requested_models(spark):
    uds = [(f"u{i}", D1, 10 + i, 1) for i in range(6)]
    scores = [(f"u{i}", D1, m, 0.5, 10 - i) for i in range(5) for m in ("a", "b")]
    dec = lift.ctr_by_decile(spark.createDataFrame(uds, UD_SCHEMA), lift.prepare_scores(spark.createDataFrame(scores, SC_SCHEMA), P), ["b", "a"])
    rows = lift.ctr_by_decile_report(dec, ["b", "a"]).collect()
    assert [(r.model_no, r.model, r.decile) for r in rows] == [(n, m, d) for n, m in ((1, "b"), (2, "a")) for d in (None, 6, 7, 8, 9, 10)]
    bands = lift.ctr_by_band_report(lift.ctr_by_band(dec), ["b", "a"]).collect()
    assert [(r.model, r.DecileGroup) for r in bands] == [(m, b) for m in ("b", "a") for b in ("2. M", "3. L", "Unscored")]
