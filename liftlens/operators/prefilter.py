"""A Bloom filter of fixed size as a plan: built by an aggregate over the keys,
applied to another table right after its scan.

The filter is a table of 64-bit words. A key sets three bits of one word, so a
test looks up one word, by a broadcast hash join that moves no row of the
tested table. A key that was put in is never missed; other keys pass with a
probability that grows with the number of keys for a word, which costs work and
never changes a result. The number of words is set by the caller, so the
broadcast has a bound that does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 64-bit words of a filter (a power of two): 8 million bits, for 800,000 keys at ten bits a key.
FILTER_WORDS = 1 << 17
MAX_FILTER_WORDS = 1 << 20  # rows of the broadcast
_SHIFTS = (40, 46, 52)  # six bits of the hash for each bit of the word, above those that choose the word
_WORD, _BITS = "__filter_word", "__filter_bits"


def _hash(columns) -> str:
    return "xxhash64(" + ", ".join(f"`{c}`" for c in columns) + ")"


def _word(columns, words: int) -> Column:
    return F.expr(f"{_hash(columns)} & {words - 1}L")


def _bits(columns) -> str:
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({_hash(columns)}, {s}) & 63 as int))" for s in _SHIFTS) + ")"


def check_words(words: int) -> int:
    if words < 1 or words & (words - 1) or words > MAX_FILTER_WORDS:
        raise ValueError(f"a filter has a power of two of words, at most {MAX_FILTER_WORDS}, got {words}")
    return words


def key_filter(keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The filter over all rows of ``keys`` (all of its columns are the key; rows
    with a NULL in one are left out): at most ``words`` rows.

    Keys are folded into words map-side, so a task sends at most ``words`` rows
    and copies of a key cost nothing further.
    """
    check_words(words)
    marks = keys.dropna().select(_word(keys.columns, words).alias(_WORD), F.expr(_bits(keys.columns)).alias(_BITS))
    return marks.groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS))


def mark_listed(rows: DataFrame, keys: DataFrame, columns, into: str, words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` with a boolean column ``into``: False only where the key in
    ``columns`` is not among the rows of ``keys`` (same columns in number, order
    and type); a key with a NULL is not listed."""
    looked_up = rows.join(F.broadcast(key_filter(keys, words)), _word(columns, words) == F.col(_WORD), "left")
    whole = " and ".join(f"`{c}` is not null" for c in columns)
    listed = F.expr(f"{whole} and coalesce(`{_BITS}` & {_bits(columns)} = {_bits(columns)}, false)")
    return looked_up.select(*rows.columns, listed.alias(into))
