"""Shared helpers of the operator tests: the session comes from tests/conftest.py."""

import random

import pytest

EXTRA = ["sequence_id", "offset", "path", "chunk", "row", "word", "sig", "host"]


@pytest.fixture
def frame(spark):
    """Build a (id, text) frame with extra columns whose names clash with inner ones."""

    def make(rows, key="doc_id", text="text", **more):
        kinds = "".join(f", {c} {t}" for c, (t, _) in more.items())
        schema = f"{key} long, {text} string{kinds}, " + ", ".join(f"{c} string" for c in EXTRA)
        data = [(k, t, *(v[i] for _, v in more.values()), *["x"] * len(EXTRA)) for i, (k, t) in enumerate(rows)]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture
def prose():
    """Deterministic invented prose."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice(["an", "er", "the", "on", "ti", "re", "la", "ö", "que"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def make(n, seed=0):
        r = random.Random(seed)
        words = [r.choice(vocab) for _ in range(n)]
        return " ".join(w.capitalize() + ("." if i % 11 == 10 else "") for i, w in enumerate(words))

    return make
