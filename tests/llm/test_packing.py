from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from liftlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  a", "it's <|endoftext|> x", "ΑΣ Σ.", "İstanbul!! éx.", "Straße, ﬁn", "a\tb\r\nc\x1cd", "́ ́b", "ÀÉ:!?;; 3.14%", "w" * 300]


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_equals_whole_texts(prose):
    texts = [*ODD, *(prose(80, i) for i in range(20))]
    own = packing.WordEncoder(PATH)
    assert own.encode(texts) == whole(texts)
    assert own.encode(texts) == whole(texts)  # from the caches


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé.ſKİΣ' \n\t5%́ß<|>endoftext"), max_size=40))
def test_encoder_property(text):
    assert packing.encoder(PATH).encode([text]) == whole([text])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_equals_a_linear_search(lengths):
    windows, plain = packing.OpenWindows(64), []
    for n in sorted(lengths, reverse=True):
        number, offset = windows.place(n)
        fitting = [free for free in plain if free >= n]
        if fitting:
            assert 64 - offset == min(fitting)
            plain.remove(min(fitting))
        else:
            assert offset == 0
        plain.append((min(fitting) if fitting else 64) - n)
    assert windows.count == len(plain)


def test_every_id_once_and_little_padding(spark, frame, prose):
    rows = [(i, prose(5 + 37 * i % 700, i)) for i in range(60)] + [(60, None), (61, ""), (None, prose(30)), (3, prose(5)), (70, prose(9000))]
    docs = frame(rows)
    packed = packing.pack_documents(docs, PATH, window=1024)
    got = packed.collect()
    texts = defaultdict(list)
    for key, raw in zip((k for k, _ in rows), whole([t for _, t in rows])):
        texts[key].append(raw + b"\2\0\0\0")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 <= 1024
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    seen = sorted(b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start)) for pieces in by_doc.values())
    assert seen == sorted(t for own in texts.values() for t in own)
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        used = sum(p.length for p in pieces)
        total += used
        padding += packing.padding(used, 1024)
    assert padding <= 1024 + 0.01 * total
    sequences = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for number, pieces in by_sequence.items():
        assert bytes(sequences[number].ids) == b"".join(p.ids for p in pieces)


def test_empty_table(spark, frame):
    assert packing.pack_documents(frame([]), PATH).count() == 0


@pytest.mark.parametrize(("length", "padded"), [(4096, 0), (1024, 0), (1, 0), (3000, 1096)])
def test_padding(length, padded):
    assert packing.padding(length) == padded
