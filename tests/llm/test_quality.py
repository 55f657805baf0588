import re

import numpy as np
import pytest

from liftlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_measures_equal_brute_force(spark, frame, prose):
    texts = [None, "", " \n\t", "a", "a b c d e f g h " * 5, "x " * 9, "x y z\x1c", prose(300), prose(60) + "\n" + prose(60), "l1 a.\nl1 a.\n\nl1 a.", prose(20_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose(30)), (3, "a")]
    got = quality.judge(frame(rows)).collect()
    assert len(got) == len(rows)
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str)
    assert mine == sorted(((k, *base(t)) for k, t in rows), key=str)


def test_hash_collisions_cannot_change_counts(monkeypatch):
    words = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 20] * 3)
    bounds = np.array([0, 18, 54])
    assert quality.repeated_words(words, bounds).tolist() == [16, 36]
    monkeypatch.setattr(quality, "HASH_BITS", 3)  # nearly all windows collide
    assert quality.repeated_words(words, bounds).tolist() == [16, 36]


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("A plain sentence of prose ends like this.", None),
        ("", None),
        ("Home | News | Sport | About us", "navigation"),
        ("de%%% êeux*** ouier### ond$$$ la.", "symbols"),
        ("a line without an end", "punctuation"),
        ("SE!! CIÓN!! EAR!! NO!!", "punctuation"),
        ("All rights reserved.", "boilerplate"),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line) == fault


def test_verdict(spark, frame, prose):
    clean = prose(98) + " end."
    junk = "\n".join(["Home | News | Sport | About us | More"] * 1 + [f"Item {i} | x | y | z | w | v | u" for i in range(20)])
    rows = [(0, clean), (1, clean + "\nHome | News | Sport | About us"), (2, junk + "\n" + "One two."), (3, "short."), (4, None)]
    got = {r.doc_id: r for r in quality.judge(frame(rows)).collect()}
    assert [got[i].kept for i in range(5)] == [True, True, False, False, False]
    assert got[1].text == clean and got[4].text is None and got[1].removed_lines == [0, 0, 1, 0]


def test_empty_table(spark, frame):
    assert quality.judge(frame([])).count() == 0
