"""Line-first cleaning of documents.

Each line is judged by punctuation, navigation, symbol and boilerplate rules.
Failed lines are removed; a document that loses too large a share of its words
is rejected. Base measures of the whole text come along: word, symbol and
repetition counts. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_type, index_words, slices

REPEAT_WINDOW = 8
MIN_WORDS = 20
HASH_BITS = 64
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

LINE_END = tuple(".!?:;…。！？।؟\"'”’»)]")
SEPARATORS = re.compile(r"\s[|•·»›>]\s|\s[|•·»›>]$")
SHOUTED = re.compile(r"[!?]{2,}")
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|accept cookies"
    r"|enable javascript|javascript is (?:disabled|required)|lorem ipsum|subscribe to our newsletter"
    r"|sign (?:in|up) to|log ?in to|click here|skip to (?:main )?content|back to top|share (?:this|on)"
    r"|copyright (?:\(c\)|©)|©\s*\d{4}",
    re.ASCII | re.IGNORECASE,
)
RULES = ("punctuation", "symbols", "navigation", "boilerplate")


def line_fault(line: str) -> str | None:
    """The first rule that a line fails, or None. Lines without a word pass.

    navigation: at least three separators between short items; symbols: a
    symbol for every second word or more, three at least; punctuation: no
    closing mark at the end of a line, or doubled marks after a fifth of the
    words or more; boilerplate: a fixed phrase of page furniture in a line of
    at most 30 words.
    """
    bare = line.strip()
    if not bare:
        return None
    words = len(bare.split())
    separators = len(SEPARATORS.findall(bare))
    if separators >= 3 and words <= 4 * (separators + 1):
        return "navigation"
    symbols = sum(bare.count(c) for c in "#*$%&|<>")
    if symbols >= 3 and 2 * symbols >= words:
        return "symbols"
    if not bare.endswith(LINE_END):
        return "punctuation"
    shouted = len(SHOUTED.findall(bare)) if "!!" in bare or "??" in bare else 0
    if shouted >= 3 and 5 * shouted >= words:
        return "punctuation"
    if words <= 30 and BOILERPLATE.search(bare):
        return "boilerplate"
    return None


def repeated_words(words: np.ndarray, bounds: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, how many of its words lie in windows found at least twice in it.

    Windows are hashed and sorted; windows of equal hash are then compared word
    by word, so a hash collision cannot change the count.
    """
    n, texts = len(words), len(bounds) - 1
    counts = np.zeros(texts, dtype=np.int64)
    if n < window:
        return counts
    text = np.repeat(np.arange(texts, dtype=np.int64), np.diff(bounds))
    starts = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    with np.errstate(over="ignore"):
        key = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = key[: n - window + 1].copy()
        for i in range(window):
            key = (key ^ words[i : n - window + 1 + i].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(29)
    key = key[starts] >> np.uint64(64 - HASH_BITS)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    first, second = starts[order[same]], starts[order[same + 1]]  # neighbours by hash
    found = np.unique(np.concatenate([first, second]))
    if not len(found):
        return counts
    equal = text[first] == text[second]
    for i in range(window):
        equal &= words[first + i] == words[second + i]
    if not equal.all():  # different windows share a hash: group the few found ones exactly
        rows = np.column_stack([text[found], *(words[found + i] for i in range(window))])
        _, where, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = found[times[where.ravel()] > 1]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + window, -1)
    covered = np.cumsum(cover[:n]) > 0
    np.add.at(counts, text[covered], 1)
    return counts


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_lost_percent: int = MAX_LOST_PERCENT,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row, in the order of the input partition.

    Columns: the id; n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long); base_failed; lost_words (words of removed lines),
    removed_lines (per rule, in the order of RULES); kept; and, if
    ``with_text``, text (the remaining lines; null for a null text).

    A null or empty text has no words and fails the base. Repeated rows and
    null ids are judged like any other row. Very long texts are judged whole.
    """
    kind = arrow_type(docs, id_col)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema(
        [(id_col, kind), *((c, pa.int64()) for c in longs), ("base_failed", pa.bool_()), ("lost_words", pa.int64())]
        + [("removed_lines", pa.list_(pa.int64())), ("kept", pa.bool_())]
        + ([("text", pa.string())] if with_text else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                raw = [(t or "").encode() for t in texts]
                words, bounds, _ = index_words([r.split() for r in raw])
                n_words = np.diff(bounds)
                repeated = repeated_words(words, bounds)
                rows = []
                for key, text, data, n, rep in zip(part.column(0).to_pylist(), texts, raw, n_words.tolist(), repeated.tolist()):
                    lines = (text or "").split("\n")
                    # str.strip() knows more white space than the six characters that part words
                    filled = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
                    chars = len(text or "") - (len(data) - len(data.translate(None, SPACES)))
                    symbols = len(data) - len(data.translate(None, SYMBOLS))
                    failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
                    removed, lost, left = [0] * len(RULES), 0, []
                    for line in lines:
                        fault = line_fault(line)
                        if fault:
                            removed[RULES.index(fault)] += 1
                            lost += len(line.encode().split())
                        else:
                            left.append(line)
                    kept = not failed and 100 * lost <= max_lost_percent * n
                    row = [key, n, chars, symbols, len(filled) - len(set(filled)), rep, failed, lost, removed, kept]
                    rows.append(row + ([None if text is None else "\n".join(left)] if with_text else []))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs)]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("lost_words", T.LongType())]
        + [T.StructField("removed_lines", T.ArrayType(T.LongType())), T.StructField("kept", T.BooleanType())]
        + ([T.StructField("text", T.StringType())] if with_text else [])
    )
    return docs.select(id_col, text_col).mapInArrow(run, out)
