"""Best-score overlap between two models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from liftlens.operators import overlap
from liftlens.params import Params

P = Params(dt.date(2020, 1, 1), dt.date(2020, 1, 5), (1,), ("a", "b"))
SC = "xid string, date date, tid string, score double, decile int"


def _scores(seed, n=300):
    rng = random.Random(seed)
    return [
        (f"u{rng.randint(0, 40)}", dt.date(2020, 1, rng.randint(1, 6)), rng.choice(["a", "b", "c"]),
         rng.choice([None, round(rng.random(), 3)]), rng.choice([None, *range(1, 11)]))
        for _ in range(n)
    ]


def _cells(sc, model1, model2):
    return overlap.overlap_by_decile(overlap.overlap_state(overlap.best_score_pairs(sc, P, model1, model2)))


def _join_formulation(sc, p):
    """Two grouped frames joined on the user id, as the dashboard wrote it."""
    w = sc.filter(F.col("date").between(F.lit(p.start_date), F.lit(p.end_date)))
    t1 = w.filter(F.col("tid") == p.model1).groupBy("xid").agg(F.min("decile").alias("tid1Decile"), F.max("score").alias("tid1Score"))
    t2 = w.filter(F.col("tid") == p.model2).groupBy("xid").agg(F.min("decile").alias("tid2Decile"), F.max("score").alias("tid2Score"))
    return t1.join(t2, "xid")


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_join_of_grouped_frames(spark, seed):
    sc = spark.createDataFrame(_scores(seed), SC)
    got = sorted(overlap.best_score_pairs(sc, P, "a", "b").collect())
    want = sorted(_join_formulation(sc, P).select("xid", "tid1Decile", "tid1Score", "tid2Decile", "tid2Score").collect())
    assert got == want


def test_overlap_swapped_models_is_transpose(spark):
    sc = spark.createDataFrame(_scores(5), SC)
    ab = {(r.tid1Decile, r.tid2Decile): r["count"] for r in _cells(sc, "a", "b").collect()}
    ba = {(r.tid2Decile, r.tid1Decile): r["count"] for r in _cells(sc, "b", "a").collect()}
    assert ab == ba


def test_band_cells_equal_banding_before_join(spark):
    sc = spark.createDataFrame(_scores(6), SC)
    from liftlens.functions.columns import band

    j = _join_formulation(sc, P)
    want = {(r.g1, r.g2): r.n for r in j.groupBy(band("tid1Decile").alias("g1"), band("tid2Decile").alias("g2")).agg(F.count("*").alias("n")).collect()}
    cells = _cells(sc, "a", "b")
    got = {(r.DecileGroup1, r.DecileGroup2): r["count"] for r in overlap.overlap_by_band(cells).collect()}
    assert got == want


def test_matrix_shape_and_column_shares(spark):
    sc = spark.createDataFrame(_scores(7), SC)
    cells = _cells(sc, "a", "b")
    m = overlap.overlap_decile_matrix(cells).collect()
    assert len(m) == 100
    for col in range(1, 11):
        shares = [r.pct for r in m if r.tid2Decile == col]
        if all(s is None for s in shares):
            assert all(r.n == 0 for r in m if r.tid2Decile == col)
        else:
            assert sum(shares) == pytest.approx(1.0)
    assert sum(r.is_diagonal for r in m) == 10
    b = overlap.overlap_band_matrix(overlap.overlap_by_band(cells)).collect()
    assert len(b) == 9
    wide = overlap.overlap_decile_wide(overlap.overlap_decile_matrix(cells)).collect()
    assert len(wide) == 10 and sum(sum(r[str(c)] for c in range(1, 11)) for r in wide) == sum(r.n for r in m)


def test_labels(spark):
    cells = spark.createDataFrame([(1, 1, 1), (2, 1, 7), (1, 2, 1234)], "tid1Decile int, tid2Decile int, count bigint")
    m = {(r.tid1Decile, r.tid2Decile): r for r in overlap.overlap_decile_matrix(cells).collect()}
    assert m[(1, 1)].pct_label == "12%"  # 1/8 = 12.5% rounds half even
    assert m[(2, 1)].pct_label == "88%"
    assert m[(1, 2)].n_label == "1,234" and m[(1, 2)].pct_label == "100%"
    assert m[(1, 3)].pct is None and m[(1, 3)].pct_label is None and m[(1, 3)].n_label == "0"


def test_correlation_counts_missing_score_as_zero(spark):
    pairs = spark.createDataFrame([("u1", 1, 0.5, 1, None), ("u2", 2, None, 3, 0.7), ("u3", 3, 0.9, 2, 0.2)],
                                  "xid string, tid1Decile int, tid1Score double, tid2Decile int, tid2Score double")
    r = overlap.score_correlation(overlap.overlap_state(pairs)).collect()[0]
    import numpy as np

    assert r.n_users == 3
    assert r.correlation == pytest.approx(np.corrcoef([0.5, 0, 0.9], [0, 0.7, 0.2])[0, 1], abs=1e-12)


PAIRS = "xid string, tid1Decile int, tid1Score double, tid2Decile int, tid2Score double"


def _users(seed, n, offset=0.0):
    rng = random.Random(seed)
    decile = lambda: rng.choice([None, *range(1, 11)])
    score = lambda: rng.choice([None, offset + rng.random(), offset + rng.random()])
    return [(f"{seed}-{i}", decile(), score(), decile(), score()) for i in range(n)]


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_state_of_parts_merges_exactly(spark, offset):
    """States over different users, put together, give the numbers of all users,
    also where the scores are far from zero."""
    import numpy as np

    parts = [_users(seed, 400, offset) for seed in range(3)]
    frames = [overlap.overlap_state(spark.createDataFrame(p, PAIRS)) for p in parts]
    together = frames[0].unionByName(frames[1]).unionByName(frames[2])
    merged = overlap.merge_state(together, "tid1Decile", "tid2Decile")
    assert merged.count() <= 121
    rows = [r for p in parts for r in p]
    x, y = (np.array([r[i] or 0.0 for r in rows]) for i in (2, 4))
    for state in (together, merged):
        got = overlap.score_correlation(state).first()
        assert got.n_users == len(rows) and got.correlation == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    whole = {(r.tid1Decile, r.tid2Decile): r for r in overlap.overlap_state(spark.createDataFrame(rows, PAIRS)).collect()}
    for r in merged.collect():
        want = whole[r.tid1Decile, r.tid2Decile]
        assert (r["count"], r.least1, r.most2) == (want["count"], want.least1, want.most2)
        assert (r.mean1, r.square1, r["product"]) == pytest.approx((want.mean1, want.square1, want["product"]), rel=1e-6, abs=1e-6 * max(offset, 1))
    counts = {(r.tid1Decile, r.tid2Decile): r["count"] for r in overlap.overlap_by_decile(together).collect()}
    assert counts == {k: r["count"] for k, r in whole.items()}


def test_correlation_of_constant_or_missing_scores(spark):
    def of(rows):
        return tuple(overlap.score_correlation(overlap.overlap_state(spark.createDataFrame(rows, PAIRS))).first())

    assert of([]) == (0, None)
    assert of([("u", 1, 0.5, 2, 0.7)]) == (1, None)
    assert of([(f"u{i}", i % 10, 0.1, i % 7, i / 7) for i in range(100)]) == (100, None)  # 0.1 in many cells
