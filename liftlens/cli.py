"""Command-line entry point: the dashboard as one batch job.

    spark-submit --py-files liftlens.zip liftlens/cli.py --start 2022-09-01 --end 2022-09-30 \\
        --orders 123,456 --model1 modelA --model2 modelB --out /shared/reports/run1 \\
        --impressions logs.impressions --clicks logs.clicks --scores models.scores \\
        --line-item-table dim.line_items --segments dim.segments

The six dashboard inputs become arguments; all reports are published as one run
under ``--out`` (a shared folder). The user-day rollup, decile sums and overlap
state are written once into ``spark.checkpoint.dir``; the rollup is dropped at the end.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from liftlens.constants import DEFAULT_ALPHA, USER_ID_KEY
from liftlens.params import Params
from liftlens.plans.dashboard import Dashboard
from liftlens.sources.catalog import TableNames, read_catalog


def parse_args(argv=None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="liftlens", description=__doc__.split("\n\n")[0])
    ap.add_argument("--start", required=True, help="first day, YYYY-MM-DD")
    ap.add_argument("--end", required=True, help="last day, YYYY-MM-DD (inclusive)")
    ap.add_argument("--orders", required=True, help="comma separated order ids")
    ap.add_argument("--model1", required=True)
    ap.add_argument("--model2", required=True)
    ap.add_argument("--line-items", dest="line_item_ids", default="", help="optional comma separated line item ids")
    ap.add_argument("--alpha", type=float, default=DEFAULT_ALPHA)
    ap.add_argument("--user-key", default=USER_ID_KEY, help="key of the targeting map that carries the user id")
    ap.add_argument("--out", required=True, help="folder for the report tables")
    defaults = TableNames()
    ap.add_argument("--impressions", default=defaults.impressions)
    ap.add_argument("--clicks", default=defaults.clicks)
    ap.add_argument("--scores", default=defaults.scores)
    ap.add_argument("--line-item-table", dest="line_item_table", default=defaults.line_items)
    ap.add_argument("--segments", default=defaults.segment_trait)
    return ap.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    params = Params.from_text(args.start, args.end, args.orders, args.model1, args.model2, args.line_item_ids, args.alpha, args.user_key)
    names = TableNames(args.impressions, args.clicks, args.scores, args.line_item_table, args.segments)
    dashboard = Dashboard(read_catalog(spark, names), params)
    try:
        return dashboard.save(args.out)
    finally:
        dashboard.release()


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = SparkSession.builder.appName("liftlens").getOrCreate()
    for name, path in run(spark, args).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
