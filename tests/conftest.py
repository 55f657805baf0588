import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from liftlens.session import ensure_checkpoint_dir, local_session

    s = local_session("*", shuffle_partitions=8, app="liftlens-tests")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return con
