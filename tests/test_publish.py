"""Reports are published as whole runs, in their order."""

import glob

import pyarrow.parquet as pq
import pytest

from liftlens.plans.dashboard import Dashboard
from liftlens.plans.publish import latest_run, publish, retire_runs
from liftlens.plans.queries import FIXTURE_PARAMS
from liftlens.sources.standins import standin_tables
from tests.conftest import SF0001


def _frame(spark, n):
    return lambda: spark.createDataFrame([(i % 3, i, f"v{n}") for i in range(40, 0, -1)], "a int, b int, v string").repartition(4)


def test_a_failing_report_leaves_the_old_run(spark, tmp_path):
    path = str(tmp_path / "out")
    assert latest_run(spark, path) is None
    first = publish(spark, path, {"x": _frame(spark, 1), "y": _frame(spark, 1)}, {"x": ("a", "b")})

    def fails():
        raise ValueError("no such report")

    with pytest.raises(ValueError):
        publish(spark, path, {"x": _frame(spark, 2), "y": fails})
    run = latest_run(spark, path)
    assert run == first
    assert {r.v for name in ("x", "y") for r in run.read(spark, name).collect()} == {"v1"}
    rows = run.read(spark, "x").collect()
    assert [(r.a, r.b) for r in rows] == sorted((i % 3, i) for i in range(1, 41))


def test_newer_runs_replace_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "out")
    runs = [publish(spark, path, {"x": _frame(spark, n)}) for n in range(3)]
    assert latest_run(spark, path) == runs[2]
    assert retire_runs(spark, path, keep=1) == [runs[1].run_id, runs[0].run_id]
    assert {r.v for r in latest_run(spark, path).read(spark, "x").collect()} == {"v2"}
    with pytest.raises(ValueError):
        retire_runs(spark, path, keep=0)


def test_saved_reports_keep_their_order(spark, tmp_path):
    """The sort spreads over several files, whose order is the report's."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    d = Dashboard(standin_tables(spark, SF0001), FIXTURE_PARAMS)
    try:
        out = d.save(str(tmp_path / "out"), ["ctr_by_decile_report", "ctr_by_band_report", "segment_names"])
    finally:
        spark.conf.set(key, old)
    run = d.saved(str(tmp_path / "out"))
    assert run.folders == out
    for name, column in (("ctr_by_decile_report", "decile"), ("ctr_by_band_report", "DecileGroup")):
        got = [(r.model_no, r.model, r[column]) for r in run.read(spark, name).collect()]
        want = sorted(got, key=lambda r: (r[0], r[2] is not None, r[2]))
        assert got == want and [m for n, m, _ in got if n == 1][0] == FIXTURE_PARAMS.model1
        files = sorted(glob.glob(f"{out[name]}/part-*.parquet"))
        stored = [(r["model_no"], r["model"], r[column]) for f in files for r in pq.read_table(f).to_pylist()]
        assert len(files) > 1 and stored == want
    d.release()
