"""Print the final physical plan trees of the key queries in their at-scale
shape: stand-ins written as date-clustered Parquet (the production layout) and
automatic broadcast joins off (as for logs far above any broadcast threshold).

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from liftlens.operators import events  # noqa: E402
from liftlens.plans.dashboard import Dashboard  # noqa: E402
from liftlens.plans.queries import DEFAULT_PARAMS  # noqa: E402
from liftlens.session import ensure_checkpoint_dir, local_session  # noqa: E402
from liftlens.sources.standins import standin_fingerprint, write_standins  # noqa: E402

KEY_QUERIES = {
    "clicks_impressions_by_user_day": lambda d: d.user_days,
    "ctr_by_decile_models": lambda d: d.ctr_by_decile(),
    "ctr_by_decile_models (materialized dashboard)": lambda d: _materialized(d),
    "z_test_high_band": lambda d: d.z_test_high_band(),
    "overlap_decile_matrix": lambda d: d.overlap_decile_matrix(),
    "score_correlation": lambda d: d.score_correlation(),
    "order_names": lambda d: d.order_names(),
}


def _materialized(d):
    d.materialize()
    d._deciles = None  # show the decile plan itself, not its checkpoint
    return d.ctr_by_decile()


def tree(df) -> str:
    df.collect()  # so the adaptive plan is final
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    body = text.split("\n\n\n")[0]
    final = body.split("+- == Initial Plan ==")[0]
    return "\n".join(line for line in final.splitlines() if line.strip())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    # the configured shared folder itself (not the per-run subfolder Spark adds),
    # so later runs reuse the written stand-ins
    shared = ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or shared
    tables = write_standins(spark, sf_dir, f"{shared}/liftlens-standins-{standin_fingerprint(sf_dir)}", 8)
    for name, build in KEY_QUERIES.items():
        print(f"### `{name}`\n\n```")
        print(tree(build(Dashboard(tables, DEFAULT_PARAMS))))
        print("```\n")


if __name__ == "__main__":
    main()
