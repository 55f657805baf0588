import random
import re
import tracemalloc

import numpy as np
import pytest

from liftlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, width=13):
    out = []
    for key, text in rows:
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            w = words(passage)
            for i in range(max(1, len(w) - width + 1)) if w and item is not None else ():
                window = w[i : i + width]
                for p in range(len(own) - len(window) + 1):
                    if own[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item))
        out.append((key, len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "on", "Été", "x1", "of", "a", "zu", "that"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 14, 30, 5, 1, 20, 13])] + [(7, None), (8, " ., "), (None, "the on"), (2, "of of of of")]
    items[4] = (4, "rarest")
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            passage = words(rng.choice(items)[1])
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 3) :] * rng.randint(1, 2)
        rows.append((i, ", ".join(body)))
    return rows + [(None, items[2][1]), (3, items[2][1]), (61, None), (62, ""), (63, "word " * 3000 + items[2][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1_000_000, 20])
def test_equals_brute_force(spark, frame, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    rows, items = data(seed)
    got = decontaminate.contamination(frame(rows), frame(items, key="item_id")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == brute(rows, items)


def test_proximity():
    text = "a b x c a q b c b a c".encode().split()
    shard = decontaminate.Shard.of([text[:8], text[8:]])
    queries = decontaminate.Queries.of([(1, [b"a", b"b", b"c"])], 13)
    for slop in range(4):
        want = []
        for lo, hi in ((0, 8), (8, 11)):
            for i in range(lo, hi):
                if text[i] == b"a":
                    b = next((j for j in range(i + 1, hi) if text[j] == b"b"), None)
                    c = next((j for j in range(b + 1, hi) if text[j] == b"c"), None) if b is not None else None
                    if c is not None and c - i + 1 <= 3 + slop:
                        want.append((0, i, c))
        assert list(zip(*(x.tolist() for x in decontaminate.search(shard, queries, slop)))) == want


@pytest.mark.parametrize("slop", [0, 2])
def test_windows_of_common_words_are_followed_in_runs(monkeypatch, slop):
    """2,000 windows of two common words against 20,000 words: the memory of a
    run does not grow with the number of windows, and nothing is lost."""
    rng = random.Random(4)
    shard = decontaminate.Shard.of([[rng.choice([b"the", b"on"]) for _ in range(20_000)]])
    items = [(i, [rng.choice([b"the", b"on"]) for _ in range(13)]) for i in range(2_000 if slop == 0 else 100)]
    queries = decontaminate.Queries.of(items, 13)
    tracemalloc.start()
    got = decontaminate.search(shard, queries, slop)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
    few = decontaminate.Queries.of(items[:50], 13)
    pairs = lambda found: sorted(zip(*(x.tolist() for x in found)))
    monkeypatch.setattr(decontaminate, "HELD_POSTINGS", 1)
    one = pairs(decontaminate.search(shard, few, slop))
    monkeypatch.setattr(decontaminate, "HELD_POSTINGS", 10**9)
    assert one == pairs(decontaminate.search(shard, few, slop)) == [p for p in pairs(got) if p[0] < len(few.windows)]


def test_empty_tables(spark, frame):
    none, one = frame([], key="item_id"), frame([(1, "a b")])
    assert decontaminate.contamination(frame([]), none).count() == 0
    (row,) = decontaminate.contamination(one, none).collect()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (2, 0, [], False)
    assert len(decontaminate.search(decontaminate.Shard.of([[]]), decontaminate.Queries.of([], 13))[0]) == 0
    assert np.array_equal(decontaminate.Shard.of([[b"a", b"b", b"a"]]).keys(), [0, 2, 4])


def test_query_counts_passages_of_items_without_an_id(spark, tmp_path):
    from liftlens.llm.queries import op9_decontaminate

    spark.createDataFrame([(1, "a b c"), (2, "x a b y z"), (3, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "a b"), (5, "y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in op9_decontaminate(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 0, True), (2, 4, 1, True), (3, 0, 0, False)]


def test_rows_of_the_index_are_held_one_by_one(spark, monkeypatch):
    """Wide rows: small row groups in the files, one row in a batch of the search, results as before."""
    import pyarrow.parquet as pq

    random_words = random.Random(7)
    vocab = [f"w{i}" for i in range(20_000)]
    texts = [(i, " ".join(random_words.choices(vocab, k=200_000))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    index = decontaminate.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > 10_000_000 and max(groups) < 9_000_000

    batches, rows = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(run):
        def count(given):
            for batch in given:
                batches.add(1)
                rows.add(batch.num_rows)
                yield batch

        return lambda given: run(count(given))

    monkeypatch.setattr(decontaminate, "tidy", counted)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    items = spark.createDataFrame([("a", " ".join(texts[5][1].split()[100:130]))], "item_id string, text string")
    found = decontaminate.find(index, items).collect()
    assert (batches.value, rows.value) == (12, 12)
    assert [(r.item, [tuple(s) for s in r.spans]) for r in found] == [("a", [(100, 130)])]
    assert [spark.conf.get(n) for n in names] == before
