"""Every registered query equals its DuckDB oracle (order-insensitive)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from liftlens.plans import oracle
from liftlens.plans.queries import QUERIES
from tests.conftest import SF0001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(round(v, 9)))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, str(v))


@pytest.fixture(scope="module")
def oracle_con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle.oracle_sql())
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, oracle_con, name):
    df = E.queries()[name](spark, SF0001)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in (x.asDict() for x in df.collect()))
    rel = oracle_con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(_norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "tid", "decile", "impressions", "clicks", "ctr"]
    assert df.count() > 0
