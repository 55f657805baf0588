
import pytest

import __spark_entry__ as E
import corpus_pipeline
from liftlens.llm import packing, secrets
from liftlens.llm.common import materialize, scratch, without
from liftlens.session import path_exists
from tests.conftest import SF0001
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_dup import brute as duplicates


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF0001}/documents.parquet")
    docs = documents
    items = [tuple(r) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, SF0001)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        after = {r.doc_id: r for r in docs.collect()}
        rows = [(r.doc_id, r.text) for r in before]
        if name == "deduplicate":
            assert set(after) == {k for k, _, _, kept in duplicates(rows) if kept}
        elif name == "decontaminated":
            assert set(after) == {r[0] for r in hits(rows, items) if not r[4]}
        elif name == "redacted":
            assert {k: r.text for k, r in after.items()} == {k: secrets.redact(t, secrets.scan_text(t)[1]) for k, t in rows}
            assert not any(secrets.base_spans(r.text) for r in after.values())
        else:
            assert len(after) >= 0.95 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF0001).collect()
    assert {p.doc_id for p in pieces} == set(after) and sum(p.length for p in pieces if p.start == 0) > 0


def test_odd_rows_pass_every_stage(spark):
    schema = spark.read.parquet(f"{SF0001}/documents.parquet").schema
    some = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").limit(12).collect()]
    odd = [(None, None, None, None, None), (900, "", None, "s", 0), (901, "12 34", "en", None, None), (None, some[0][1], "en", None, 1), some[3], some[3]]
    for rows in ([], some + odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF0001)
        assert (docs.count() > 0) == bool(rows)


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n.startswith("op")))
def test_queries_equal_their_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF0001}/{t}.parquet'")
    df = E.queries()[name](spark, SF0001)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({E.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_rows_without_listed_ids(spark):
    """Exact whatever the filter lets through; null ids and repeated rows stay."""
    rows = spark.createDataFrame([(i % 900, f"t{i}", "x") for i in range(1000)] + [(None, "none", "x")], "doc_id long, text string, _listed string")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 3)] + [(None,)], "doc_id long")
    got = without(rows, ids, "doc_id")
    assert got.columns == rows.columns
    want = [(i % 900, f"t{i}", "x") for i in range(1000) if i % 900 % 3] + [(None, "none", "x")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert without(rows, ids.limit(0), "doc_id").count() == rows.count()


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with scratch(spark):
        used = materialize(spark.range(5), "used")
        kept = materialize(used.filter("id > 2"), "kept", stays=True)
        path = used.inputFiles()[0].rsplit("/", 1)[0]
        assert path_exists(spark, path)
    assert not path_exists(spark, path)
    assert sorted(r.id for r in kept.collect()) == [3, 4]


def test_registry():
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert packing.WINDOW == 4096


def test_batches_of_texts_are_bounded(spark):
    from liftlens.llm.common import bound_batches

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, (0, 4096)):
            spark.conf.set(n, v)
        bound_batches(spark, 100)
        assert [int(spark.conf.get(n)) for n in names] == [100, 50]
        bound_batches(spark)  # a smaller bound stays
        assert [int(spark.conf.get(n)) for n in names] == [100, 50]
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
