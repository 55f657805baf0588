import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from liftlens.llm import hmm_lm


def test_scaled_recursion_equals_all_paths():
    rng = np.random.default_rng(1)
    p = hmm_lm.Parameters(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    texts = [[0, 3, 4], [2], [1, 1, 4, 0, 2], [4]]
    bounds = np.cumsum([0, *map(len, texts)])
    laid = hmm_lm.InStep(np.concatenate(texts), bounds)
    got = laid.log_likelihood(p)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for text, value in zip(texts, got):
        paths = {}
        for path in itertools.product(range(3), repeat=len(text)):
            q = p.start[path[0]] * math.prod(p.emit[o, s] for o, s in zip(text, path))
            paths[path] = q * math.prod(p.move[a, b] for a, b in zip(path, path[1:]))
        total = sum(paths.values())
        assert math.isclose(value, math.log(total), rel_tol=1e-12)
        for path, q in paths.items():
            starts[path[0]] += q / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += q / total
            for o, s in zip(text, path):
                emits[o, s] += q / total
    for mine, want in zip(laid.expected(p), (starts, moves, emits)):
        assert np.allclose(mine, want)


def test_scores(spark, frame, prose):
    rows = [(i, prose(20 + i, i)) for i in range(40)] + [(40, None), (41, ""), (42, "unseen zzz Zzz"), (None, "the on"), (3, "the on")]
    docs = frame(rows)
    train = docs.filter(~hmm_lm.held_out("doc_id"))
    held = {k for k, _ in rows if k is not None and zlib.crc32(str(k).encode()) % 10 == 0}
    counts = Counter()
    for k, t in rows:
        if k not in held:
            counts.update((t or "").lower().encode().split())
            counts[b" "] += 1
    n, v = sum(counts.values()), len(counts)
    # small bounds, so that the buckets and the join take part
    model = hmm_lm.train(train, symbols=20, counted=60, sample_docs=10)
    got = hmm_lm.score(docs, model).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = []
    for k, t in rows:
        tokens = [*(t or "").lower().encode().split(), b" "]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((k, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    assert sorted([(*r[:4], round(r[4], 6)) for r in got], key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # the broadcast bound changes nothing
    whole = hmm_lm.score(docs, hmm_lm.Model(hmm_lm.learn_vocabulary(model.counts, symbols=20), model.parameters, model.counts)).collect()
    assert np.allclose(sorted(r.score for r in whole), sorted(r.score for r in got))


def test_probabilities_sum_to_one(spark, frame, prose):
    model = hmm_lm.train(frame([(i, prose(60, i)) for i in range(20)]), symbols=20, counted=60, sample_docs=10)
    assert np.allclose(model.parameters.emit.sum(axis=0), 1) and np.allclose(model.parameters.move.sum(axis=1), 1)


def test_likelihood_rises(spark, frame, prose):
    docs = frame([(i, prose(200, i)) for i in range(30)])
    totals = [hmm_lm.score(docs, hmm_lm.train(docs, passes=k, sample_docs=5)).agg(F.sum("score")).first()[0] for k in (1, 3)]
    assert totals[1] >= totals[0]


def test_empty_tables(spark, frame):
    model = hmm_lm.train(frame([]))
    assert hmm_lm.score(frame([]), model).count() == 0
    (row,) = hmm_lm.score(frame([(1, "a b")]), model).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_every_text_shapes_the_parameters(spark, frame, prose):
    """The ids of the texts choose none of them, and long ones count like others."""
    texts = [prose(50 + i, i) for i in range(30)] + [prose(6000, 99)]
    assert len(texts[-1]) > 20_000
    one, other = (hmm_lm.train(frame([(k * 7919 + i, t) for i, t in enumerate(texts)]), sample_docs=4).parameters for k in (0, 1))
    for a, b in ((one.start, other.start), (one.move, other.move), (one.emit, other.emit)):
        assert np.allclose(a, b)
    # as one pass after the other over all texts at once
    vocab = hmm_lm.train(frame(list(enumerate(texts))), passes=0).vocab
    symbols, bounds, *_ = vocab.observations([hmm_lm.words_of(t) for t in texts])
    want = hmm_lm.first_parameters(vocab, hmm_lm.STATES)
    for _ in range(hmm_lm.PASSES):
        want = hmm_lm.estimate(*hmm_lm.InStep(symbols, bounds).expected(want), vocab.prior())
    assert np.allclose(one.emit, want.emit) and np.allclose(one.move, want.move)


def test_symbols_of_all_texts_are_written(spark, frame):
    docs = frame([(1, "a b a"), (2, None), (3, ""), (3, "")])
    vocab = hmm_lm.train(docs, passes=0).vocab
    for vocab.symbols in (2, 70_000):  # two bytes a symbol, four bytes
        kind = hmm_lm._kind(vocab)
        vocab.words = {b"a": 0, b"b": 1}
        got = sorted(np.frombuffer(r.symbols, kind).tolist() for r in hmm_lm.encode(docs, vocab).collect())
        end = vocab.n_symbols - 1
        assert got == [[0, 1, 0, end], [end], [end], [end]]
