"""Ranked lexical search against brute force, and the query-sharing graph."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from liftlens.llm import shared_terms

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]


def brute(docs, items, k):
    counts = [(key, Counter(words(t))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        hits = []
        for i, (key, c) in enumerate(counts):
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                hits.append((-score, key is None, key or 0, i, key))
        out += [(item, rank, h[4], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    vocab = ["the", "On", "ÉTÉ", "été", "x1", "of", "a", "zu", "that"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(120)]
    docs += [(200 + i, docs[5][1]) for i in range(30)]  # ties
    docs += [(None, docs[6][1]), (7, docs[7][1]), (300, None), (301, ""), (302, " .,!"), (303, "the " * 5000 + "w1")]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)]
    items += [(25, items[0][1] + " " + items[1][1]), (26, None), (27, ""), (28, "unseen"), (3, items[3][1]), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed, held", [(1, 2_000_000), (2, 500)])
def test_equals_brute_force(spark, frame, monkeypatch, seed, held):
    monkeypatch.setattr(shared_terms, "ACCUMULATORS", held)
    docs, items = data(seed)
    got = shared_terms.search(frame(docs).repartition(3), frame(items, key="item_id"), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 10)


def test_items_in_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(shared_terms, "BLOCK_TERMS", 60)
    docs, items = data(3)
    got = shared_terms.search(frame(docs[:40]), frame(items, key="item_id"), 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs[:40], items, 5)


@pytest.mark.parametrize("pairs", [2_000_000, 30, 0])
def test_graph_keeps_the_terms_of_every_item(monkeypatch, pairs):
    monkeypatch.setattr(shared_terms, "PLANNED_PAIRS", pairs)
    rng = random.Random(4)
    common = [f"c{i}".encode() for i in range(12)]
    items = [(10 + n, sorted(set(rng.sample(common, rng.randint(2, 9)) + [f"own{n}{j}".encode() for j in range(3)]))) for n in range(30)]
    made = shared_terms.plan(items)
    terms = [[t for t, i in made.vocab.items() if made.group[i] == node] for node in range(made.leaves)]
    for a, b in made.sums:
        assert not set(terms[a]) & set(terms[b])
        terms.append(terms[a] + terms[b])
    assert len(terms) == made.nodes
    for (number, own), (same, nodes) in zip(items, made.items):
        assert number == same and sorted(t for n in nodes for t in terms[n]) == own
    adds = len(made.sums) + sum(len(nodes) - 1 for _, nodes in made.items)
    groups = sum(len({made.group[made.vocab[t]] for t in own}) - 1 for _, own in items)
    assert adds < groups if pairs == 2_000_000 else adds <= groups


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(shared_terms, "PIECE_BYTES", 10)
    text = "ab cde fghijklmnopqrstuvwxyz ÀB c " * 20
    pieces = list(shared_terms.terms_in(text))
    assert len(pieces) > 10 and [w.decode() for p in pieces for w in p] == words(text)


def test_scores_of_a_run():
    made = shared_terms.plan([(0, [b"a", b"b"]), (1, [b"a", b"b", b"c"])])
    w = np.array([weight for weight in (5, 7, 11)], dtype=np.int64)
    scores = shared_terms.accumulate(made, w, np.array([3, 1]), np.array([0, 0, 1]), np.array([made.vocab[t] for t in (b"a", b"c", b"b")]), np.array([2, 1, 1]), 2, 4)
    m = [50 + 50 * 3 * 2 // 4, 50 + 50 * 2 // 4]
    part = lambda t, tf, d: int(w[made.vocab[t]]) * (10**9 * tf // (1000 * tf + 20 * m[d]))
    assert scores.tolist() == [[part(b"a", 2, 0), part(b"b", 1, 1)], [part(b"a", 2, 0) + part(b"c", 1, 0), part(b"b", 1, 1)]]


def test_empty_tables(spark, frame):
    docs, items = data(5)
    assert shared_terms.search(frame([]), frame(items, key="item_id"), 5).count() == 0
    assert shared_terms.search(frame(docs), frame([], key="item_id"), 5).count() == 0
