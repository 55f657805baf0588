"""Exact vector search and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlens.llm import lemp, maxscore, vectors

# names that the operators use inside
CLASHING = ["row", "id", "norm2", "values", "label_", "score", "rank", "order", "size"]
SCHEMA = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in CLASHING)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA)


def some(seed, n, dim=6, copies=0):
    """Random vectors of several lengths, with copies, ties, odd components and ids."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scale = rng.choice([0.05, 1, 1, 3])
        rows.append((i, [round(rng.gauss(0, 1), 2) * scale for _ in range(dim)], rng.randint(0, 3)))
    rows += [(n + i, rows[3][1], i % 3) for i in range(copies)]  # a large group of one vector
    at = n + copies
    rows += [(at, None, 1), (at + 1, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (at + 2, [float("nan")] * dim, 1), (at + 3, [float("inf")] * dim, 1)]
    rows += [(at + 4, [], 1), (at + 5, [0.5], 2), (at + 6, [0.0] * dim, 2), (at + 7, [1e30] * dim, 0), (None, rows[0][1], 2), (0, rows[1][1], None), (5, rows[5][1], 1), (5, rows[5][1], 1)]
    return rows


def usable(rows):
    out = []
    for key, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) < vectors.LIMIT for x in v):
            out.append((key, [math.floor(256 * float(np.float32(x))) for x in v], label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_rank(hit):
    score, key = hit[:2]
    return -score, key is None, key or 0


def brute_top(rows, every, k):
    rows, out = usable(rows), []
    for i, (key, v, _) in enumerate(rows):
        if key is not None and key % every == 0:
            hits = sorted(((product(v, w), other) for j, (other, w, _) in enumerate(rows) if j != i), key=by_rank)[:k]
            out += [(key, rank, other, score) for rank, (score, other) in enumerate(hits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, n, copies, shard", [(1, 60, 0, 8192), (2, 200, 90, 16), (3, 12, 0, 1)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, n, copies, shard):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    rows = some(seed, n, copies=copies)
    found = vectors.integer_vectors(frame(spark, rows).repartition(3))
    got = maxscore.top_k(maxscore.build_index(found), found.filter(F.col("id") % 5 == 0), 4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 5, 4)


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300)
    monkeypatch.setattr(vectors.in_blocks, "__defaults__", (300,))
    rows = some(4, 40)
    found = vectors.integer_vectors(frame(spark, rows))
    assert len(list(vectors.in_blocks(found))) > 3
    got = maxscore.top_k(maxscore.build_index(found), found.filter(F.col("id") % 2 == 0), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 2, 3)


def test_non_essential_terms_skip_rows():
    """With a high bar only postings of a few terms are read, and every row over the bar is found."""
    rng = np.random.default_rng(5)
    m = np.floor(256 * rng.normal(size=(2000, 16)) ** 3).astype(np.int64)
    order = np.argsort(m.T, axis=1, kind="stable")
    size = len(m)
    shard = maxscore.Shard(np.arange(size), np.arange(size), np.zeros(size, bool), order, np.take_along_axis(m.T, order, 1), np.ascontiguousarray(m.T))
    for q in m[:20]:
        scores = m @ q
        for share in (0.2, 0.9, 1.0, 1.1):
            least = share * scores.max()
            at, found = maxscore.search(shard, q, least)
            assert sorted(zip(at, found)) == [(i, s) for i, s in enumerate(scores) if s >= least]


def test_types_stay_exact(spark):
    """Products beyond 2^53 are added as integers."""
    big = float(vectors.LIMIT // 256 - 1)
    rows = [(0, [big] * 64, 1), (1, [big] * 63 + [big - 1 / 256], 1), (2, [big] * 64, 2), (3, [-big] * 64, 2)]
    rows = [(k, [float(np.float32(x)) for x in v], label) for k, v, label in rows]
    found = vectors.integer_vectors(frame(spark, rows))
    got = maxscore.top_k(maxscore.build_index(found), found.filter("id = 0"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == [r for r in brute_top(rows, 5, 3) if r[0] == 0]


def test_empty_tables(spark):
    found = vectors.integer_vectors(frame(spark, []))
    assert maxscore.top_k(maxscore.build_index(found), found, 5).count() == 0
    none = vectors.integer_vectors(frame(spark, []), carry={"label": F.col("label")})
    assert lemp.hard_negatives(none, F.col("id") % 2 == 0).count() == 0


def brute_negatives(rows, every, positives, negatives):
    rows, out = [r for r in usable(rows) if r[2] is not None], []
    for i, (key, v, label) in enumerate(rows):
        if key is None or key % every:
            continue
        hits = sorted(((product(v, w), other, of) for j, (other, w, of) in enumerate(rows) if j != i), key=by_rank)
        for p, name, _ in [h for h in hits if h[2] == label][:positives]:
            hard = [h for h in hits if h[2] != label and 30 * p <= 100 * h[0] <= 90 * p][:negatives]
            out += [(key, name, rank, other, p, n) for rank, (n, other, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, n, copies, size", [(1, 80, 0, 8192), (2, 150, 80, 16), (3, 15, 0, 1)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, n, copies, size):
    monkeypatch.setattr(lemp, "BUCKET_ROWS", size)
    rows = some(seed, n, copies=copies)
    found = vectors.integer_vectors(frame(spark, rows).repartition(3), carry={"label": F.col("label")})
    got = lemp.hard_negatives(found, F.col("id") % 5 == 0, 3, 4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 5, 3, 4)
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_feasible_ranges_keep_every_row_over_the_bar():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 12))
    m = np.floor(256 * (centres[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 12)))).astype(np.int64)
    unit = lemp._directions(m)
    order = np.argsort(unit, axis=0, kind="stable").T
    size = len(m)
    longest = float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max())
    bucket = lemp.Bucket(np.arange(size), np.arange(size), np.zeros(size, bool), np.zeros(size), m, unit, order, np.take_along_axis(unit.T, order, 1), longest)
    pruned = 0
    for q in m[:30]:
        scores = m @ q
        for share in (-0.5, 0.0, 0.3, 0.9, 1.0, 2.0):
            least = share * scores.max()
            found = lemp.candidates(bucket, q, least)
            if found is not None:
                pruned += len(found) < size // 2
                assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
    assert pruned > 30
