"""Publishing the reports of a run, so that a reader never sees half of one.

A run writes each report as a Parquet table in a folder of its own and then
appends one row to the manifest table, as one file that appears at once. Readers
start from the newest manifest row. A run that fails has no row: its folder is
never read, and the run before it stays the one that is read.

    <path>/runs/<run_id>/<report>/part-*.parquet
    <path>/manifest/part-*.parquet
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.session import delete_path, path_exists

MANIFEST = "run_id string, published_at timestamp, reports map<string, array<string>>"


@dataclass(frozen=True)
class Run:
    """A published run: the folder and the order columns of each report."""

    run_id: str
    folders: dict[str, str]
    orders: dict[str, tuple[str, ...]]

    def read(self, spark: SparkSession, report: str) -> DataFrame:
        """The rows of a report, in its order where it has one."""
        frame = spark.read.parquet(self.folders[report])
        order = self.orders[report]
        return frame.orderBy(*order) if order else frame


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def _folder(path: str, run_id: str, report: str = "") -> str:
    return f"{path.rstrip('/')}/runs/{run_id}" + (f"/{report}" if report else "")


def publish(
    spark: SparkSession, path: str, reports: Mapping[str, Callable[[], DataFrame]], orders: Mapping[str, tuple[str, ...]] | None = None
) -> Run:
    """Write all ``reports`` under a new run id, then publish the run.

    ``orders`` names the columns that give a report's rows their order. Each
    report is written by as many tasks as Spark plans for it.
    """
    run_id = uuid.uuid4().hex
    orders = {name: tuple((orders or {}).get(name, ())) for name in reports}
    for name, build in reports.items():
        build().write.parquet(_folder(path, run_id, name))
    row = spark.createDataFrame([(run_id, {k: list(v) for k, v in orders.items()})], "run_id string, reports map<string, array<string>>")
    row = row.select("run_id", F.current_timestamp().alias("published_at"), "reports")
    row.coalesce(1).write.mode("append").parquet(_manifest(path))
    return Run(run_id, {name: _folder(path, run_id, name) for name in reports}, orders)


def _runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, newest run first (one row a run)."""
    return spark.read.schema(MANIFEST).parquet(_manifest(path)).orderBy(F.desc("published_at"), F.desc("run_id"))


def latest_run(spark: SparkSession, path: str) -> Run | None:
    """The newest published run under ``path``; None if there is none."""
    if not path_exists(spark, _manifest(path)):
        return None
    row = _runs(spark, path).first()
    if row is None:
        return None
    return Run(row.run_id, {name: _folder(path, row.run_id, name) for name in row.reports}, {k: tuple(v) for k, v in row.reports.items()})


def retire_runs(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the folders of published runs but the newest ``keep``; returns their ids.
    Readers hold the newest run, so at least one stays."""
    if keep < 1:
        raise ValueError(f"at least one run stays, got {keep}")
    old = [r.run_id for r in _runs(spark, path).offset(keep).select("run_id").collect()]
    for run_id in old:
        delete_path(spark, _folder(path, run_id))
    return old
