"""Placing rows on shards through a permutation-filled lookup table.

The table has a prime number of slots. Each shard has its own preference order
of the slots (a start and a step from its name). Shards take turns claiming
their next free slot until all are taken: shares differ by at most one claim
per turn, and removing a shard moves few rows of the others. A row's slot is
its key's hash modulo the table size; the table (one row per slot, a size
fixed by the caller) is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
MAX_SLOTS = 1_000_003  # bounds the broadcast: 12 bytes a slot


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The shard index of every slot. A shard of weight w claims w slots a turn."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shard names must be distinct, at least one and at most one per slot")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    start = [_hash(s, "start") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, dtype=np.int32)
    left = slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                while table[start[i]] >= 0:
                    start[i] = (start[i] + step[i]) % slots
                table[start[i]] = i
                left -= 1
                if not left:
                    return table


def key_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of md5 of its text, modulo the slots; a null key is "null"."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(rows: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """The key column with ``slot`` (long), ``shard_id`` (long) and ``shard`` (name).

    One output row per input row, nulls and repeats included (equal keys get
    equal shards). No shuffle: the table is broadcast, at most MAX_SLOTS rows.
    """
    spark = rows.sparkSession
    filled = lookup_table(shards, slots, weights)
    names = spark.createDataFrame([(i, s) for i, s in enumerate(shards)], "shard_id long, shard string")
    table = spark.createDataFrame([(i, int(s)) for i, s in enumerate(filled)], "slot long, shard_id long")
    table = table.join(F.broadcast(names), "shard_id").select("slot", "shard_id", "shard")
    keyed = rows.select(F.col(key_col), key_slot(F.col(key_col), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key_col, "slot", "shard_id", "shard")
