"""The batch entry point over catalog tables."""

import pytest

from liftlens.cli import parse_args, run
from liftlens.params import Params
from liftlens.plans.queries import FIXTURE_PARAMS, dashboard
from liftlens.sources.standins import standin_tables
from tests.conftest import SF0001


def test_cli_writes_reports_from_catalog_tables(spark, tmp_path):
    t = standin_tables(spark, SF0001)
    for name, df in (("t_imps", t.impressions), ("t_clks", t.clicks), ("t_scores", t.scores),
                     ("t_li", t.line_items), ("t_seg", t.segment_trait)):
        df.createOrReplaceTempView(name)
    args = parse_args([
        "--start", "1996-01-01", "--end", "1999-12-31", "--orders", ",".join(map(str, range(60))),
        "--model1", "1-URGENT", "--model2", "5-LOW", "--out", str(tmp_path / "out"),
        "--impressions", "t_imps", "--clicks", "t_clks", "--scores", "t_scores",
        "--line-item-table", "t_li", "--segments", "t_seg",
    ])
    out = run(spark, args)
    z = spark.read.parquet(out["z_test_high_band"]).collect()[0]
    want = dashboard(spark, SF0001, FIXTURE_PARAMS).z_test_high_band().collect()[0]
    assert (z.clicks_1, z.impressions_1, z.clicks_2, z.impressions_2) == (
        want.clicks_1, want.impressions_1, want.clicks_2, want.impressions_2)
    assert spark.read.parquet(out["overlap_decile_matrix"]).count() == 100


def test_empty_model_id_rejected():
    with pytest.raises(ValueError):
        Params.from_text("2020-01-01", "2020-01-02", "1", "a", " ")
