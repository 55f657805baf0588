import hashlib
from collections import Counter

import pytest

from liftlens.llm import maglev

NAMES = [f"s{i}" for i in range(10)]


def test_table_is_filled_in_turns():
    table = maglev.lookup_table(NAMES, 1009)
    shares = Counter(table.tolist())
    assert set(shares) == set(range(10)) and max(shares.values()) - min(shares.values()) <= 1
    weighted = Counter(maglev.lookup_table(["a", "b"], 1009, [3, 1]).tolist())
    assert abs(weighted[0] - 3 * weighted[1]) <= 3


def test_removing_a_shard_moves_little():
    before = maglev.lookup_table(NAMES, 10007)
    after = maglev.lookup_table(NAMES[:-1], 10007)
    moved = sum(1 for a, b in zip(before.tolist(), after.tolist()) if a != 9 and a != b)
    assert moved <= 0.15 * 10007


def test_placement(spark, frame):
    rows = [(i, "t") for i in range(500)] + [(None, None), (3, "x")]
    got = maglev.place(frame(rows), NAMES, slots=1009).collect()
    table = maglev.lookup_table(NAMES, 1009)
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((k is None, k) for k, _ in rows)
    for r in got:
        slot = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard_id, r.shard) == (slot, table[slot], NAMES[table[slot]])
    assert maglev.place(frame([]), NAMES, slots=1009).count() == 0


@pytest.mark.parametrize(("names", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        maglev.lookup_table(names, slots)
