"""The bench runs end to end and prints one JSON line."""

import json

import bench
from tests.conftest import SF0001


def test_bench_prints_one_json_line(spark, monkeypatch, capsys):
    monkeypatch.setenv("BENCH_SF_DIR", SF0001)
    monkeypatch.setenv("BENCH_CPUS", "4")
    monkeypatch.setenv("BENCH_RUNS", "1")
    bench.main()
    lines = [line for line in capsys.readouterr().out.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001
    assert set(bench.HEADLINE) <= set(out["queries"]) and out["value"] > 0
