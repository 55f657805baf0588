import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from liftlens.llm import langid_ppm

TRAIN = [("en", "the cat and the hat"), ("fr", "le chat et la été"), ("en", "that thin thing"), ("fr", "les chaussettes"), (None, "xyz"), ("en", None)]


def brute_bits(words, lang, order):
    counts = Counter()
    for own, text in TRAIN:
        if own == lang:
            for w in langid_ppm.words_of(text):
                coded = b" " + w + b" "
                for i in range(1, len(coded)):
                    for k in range(min(order, i) + 1):
                        counts[coded[i - k : i], coded[i]] += 1
    total = 0.0
    for w in words:
        coded = b" " + w + b" "
        for i in range(1, len(coded)):
            for k in range(min(order, i), -2, -1):
                if k < 0:
                    total += 8
                    break
                context = coded[i - k : i]
                seen = {b: n for (c, b), n in counts.items() if c == context}
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if coded[i] in seen:
                    total -= math.log2(seen[coded[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
    return total


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths_and_verdicts(spark, frame, order):
    docs = frame([(i, t) for i, (_, t) in enumerate(TRAIN)], lang=("string", [a for a, _ in TRAIN]))
    trees = langid_ppm.learn(docs, order=order)
    assert trees.langs == ["en", "fr"]
    texts = ["The thing!", "chats ÉTÉ", "q", "12 34", "", None, "東京", "the le", "th" * 500]
    words = [langid_ppm.words_of(t) for t in texts]
    for own in words:
        if own:
            for k, lang in enumerate(trees.langs):
                assert trees.word_bits(own)[:, k].sum() == pytest.approx(brute_bits(own, lang, order))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat"), (0, texts[0])]
    got = langid_ppm.identify(frame(rows), trees).collect()
    want = []
    for k, t in rows:
        bits = [brute_bits(langid_ppm.words_of(t), lang, order) for lang in trees.langs]
        if not any(c.isalpha() for c in t or ""):
            want.append((k, "und", 0.0))
        else:
            best = min(range(2), key=lambda i: (round(bits[i], 9), i))
            want.append((k, trees.langs[best], round(1 / sum(2 ** (bits[best] - b) for b in bits), 6)))
    assert sorted([(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("max_nodes", [1, 30])
def test_more_ngrams_than_are_broadcast(spark, frame, max_nodes):
    """No n-gram and no language is lost beyond the broadcast's bound."""
    train = TRAIN + [("xx", "zq")]
    docs = frame([(i, t) for i, (_, t) in enumerate(train)], lang=("string", [a for a, _ in train]))
    texts = ["The thing!", "chats ÉTÉ", "q", "zq zq", "12 34", "", None, "東京", "the le", "th" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat"), (0, texts[0])]
    asked = frame(rows).withColumnRenamed("row", "other")
    table = langid_ppm.learn(docs, max_nodes=max_nodes)
    assert table.langs == ["en", "fr", "xx"]
    found = langid_ppm.identify(asked, table, carry=("other",)).collect()
    whole = langid_ppm.identify(asked, langid_ppm.learn(docs), carry=("other",)).collect()
    got, want = (sorted([(r.doc_id, r.lang_pred, round(r.score, 6), r.other) for r in x], key=str) for x in (found, whole))
    assert got == want
    assert (3, "xx") in [r[:2] for r in got]


@pytest.mark.parametrize("max_nodes", [1, 400_000])
def test_carried_columns_may_have_any_name(spark, frame, max_nodes):
    names = ("code", "bits", "times", "letters", "_row", "_code", "_more", "__bits")
    docs = frame([(i, t) for i, (_, t) in enumerate(TRAIN)], lang=("string", [a for a, _ in TRAIN]))
    asked = frame([(1, "The thing!"), (2, "chats ÉTÉ"), (3, None)]).select("doc_id", "text", *(F.lit(f"{c}!").alias(c) for c in names))
    got = langid_ppm.identify(asked, langid_ppm.learn(docs, max_nodes=max_nodes), carry=("text", *names)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.text) for r in got) == [(1, "en", "The thing!"), (2, "fr", "chats ÉTÉ"), (3, "und", None)]
    assert all(r[c] == f"{c}!" for r in got for c in names)


def test_no_languages(spark, frame):
    trees = langid_ppm.learn(frame([], lang=("string", [])))
    assert trees.langs == []
    assert [tuple(r) for r in langid_ppm.identify(frame([(1, "the")]), trees).collect()] == [(1, "und", 0.0)]
    assert langid_ppm.identify(frame([]), trees).count() == 0


def test_held_out_accuracy(spark):
    from liftlens.llm.queries import op6_ppm

    got = op6_ppm(spark, "/root/testdata/sf0.001").filter("held_out").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.9 * len(got)
