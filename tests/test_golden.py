"""Golden numbers of the stand-in analysis (default parameters)."""

import pytest
from pyspark.sql import functions as F

from liftlens.plans.queries import FIXTURE_PARAMS, LINE_ITEM_IDS, dashboard
from liftlens.sources.catalog import read_salary
from tests.conftest import SF0001, SF001


@pytest.mark.parametrize(
    "sf_dir, n_imps, n_clicks, n_user_days, sums",
    [(SF0001, 3459, 1147, 847, (3485, 1076)), (SF001, 19782, 6659, 7464, (19905, 6239))],
)
def test_log_rollup(spark, sf_dir, n_imps, n_clicks, n_user_days, sums):
    d = dashboard(spark, sf_dir, FIXTURE_PARAMS)
    assert d.impressions().count() == n_imps
    assert d.clicks().count() == n_clicks
    ud = d.user_days
    assert ud.count() == n_user_days
    r = ud.agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c")).collect()[0]
    assert (r.i, r.c) == sums


def test_line_item_variant(spark):
    p = FIXTURE_PARAMS.with_line_items(LINE_ITEM_IDS)
    assert dashboard(spark, SF0001, p).user_days.count() == 554


@pytest.mark.parametrize(
    "sf_dir, h1, h2, z, p",
    [
        (SF0001, (55, 176), (40, 150), 0.907662545, 0.364056539),
        (SF001, (378, 1196), (373, 1136), -0.634950815, 0.525460494),
    ],
)
def test_z_test(spark, sf_dir, h1, h2, z, p):
    r = dashboard(spark, sf_dir, FIXTURE_PARAMS).z_test_high_band().collect()[0]
    assert (r.clicks_1, r.impressions_1) == h1
    assert (r.clicks_2, r.impressions_2) == h2
    assert r.z == pytest.approx(z, abs=1e-9)
    assert r.p_value == pytest.approx(p, abs=1e-9)


def test_unscored_rows(spark):
    rows = dashboard(spark, SF0001, FIXTURE_PARAMS).ctr_by_decile([FIXTURE_PARAMS.model1]).collect()
    un = {(r.tid is None): (r.clicks, r.impressions, r.ctr) for r in rows if r.decile is None}
    assert un[True] == (864, 2825, 30.58)
    assert un[False] == (1, 8, 12.5)
    assert len(rows) == 12


def test_overlap_and_correlation(spark):
    d = dashboard(spark, SF0001, FIXTURE_PARAMS)
    r = d.score_correlation().collect()[0]
    assert r.n_users == 71
    assert r.correlation == pytest.approx(0.064287581, abs=1e-9)
    assert d.overlap_by_decile().count() == 51
    assert d.order_names().count() == 60


def test_salary_csv(spark, tmp_path):
    path = tmp_path / "salary.csv"
    path.write_bytes(b"YearsExperience,Salary\r\n1.5,40000.00\r\n2.0,45500.50\r\n10.25,120000.00\r\n")
    df = read_salary(spark, str(path))
    assert df.count() == 3
    assert dict(df.dtypes) == {"YearsExperience": "double", "Salary": "double"}
    assert df.agg(F.sum("Salary")).collect()[0][0] == pytest.approx(205500.5)


def test_materialized_dashboard_equals_lazy_plans(spark):
    lazy = dashboard(spark, SF0001, FIXTURE_PARAMS)
    mat = dashboard(spark, SF0001, FIXTURE_PARAMS).materialize()
    for report in ("ctr_by_decile_report", "ctr_by_band_report", "ctr_by_decile_dense", "z_test_high_band",
                   "overlap_decile_matrix", "score_correlation"):
        a = sorted(map(str, getattr(lazy, report)().collect()))
        b = sorted(map(str, getattr(mat, report)().collect()))
        assert a == b, report
    assert sorted(map(str, lazy.ctr_by_decile([FIXTURE_PARAMS.model2]).collect())) == sorted(
        map(str, mat.ctr_by_decile([FIXTURE_PARAMS.model2]).collect()))


def test_save_writes_every_report(spark, tmp_path):
    d = dashboard(spark, SF0001, FIXTURE_PARAMS).materialize()
    out = d.save(str(tmp_path / "reports"))
    assert set(out) == set(d.REPORTS)
    back = spark.read.parquet(out["ctr_by_decile_dense"])
    assert back.count() == 20 and "ctr_label" in back.columns


def test_overlap_sf001(spark):
    d = dashboard(spark, SF001, FIXTURE_PARAMS)
    r = d.score_correlation().collect()[0]
    assert r.n_users == 754
    assert r.correlation == pytest.approx(0.042459630, abs=1e-9)
    cells = d.overlap_by_decile()
    assert cells.count() == 114
    assert cells.filter("tid1Decile is null or tid2Decile is null").count() == 16


def test_empty_window_gives_empty_or_zero_filled_reports(spark):
    import datetime as dt

    from liftlens.params import Params

    p = Params(dt.date(1980, 1, 1), dt.date(1980, 1, 31), (1, 2), FIXTURE_PARAMS.models)
    d = dashboard(spark, SF0001, p)
    assert d.user_days.count() == 0
    assert d.ctr_by_decile().count() == 0
    dense = d.ctr_by_decile_dense().collect()
    assert len(dense) == 20 and all(r.impressions == 0 and r.ctr is None for r in dense)
    z = d.z_test_high_band().collect()[0]
    assert z.z is None and z.p_value is None and z.significant is False
    m = d.overlap_decile_matrix().collect()
    assert len(m) == 100 and all(r.n == 0 and r.pct is None for r in m)
    c = d.score_correlation().collect()[0]
    assert c.n_users == 0 and c.correlation is None


def test_materialize_log_only_parameters(spark):
    from liftlens.params import Params

    p = Params(FIXTURE_PARAMS.start_date, FIXTURE_PARAMS.end_date, FIXTURE_PARAMS.order_ids, ())
    d = dashboard(spark, SF0001, p).materialize()
    assert d.user_days.count() == 847


def test_golden_numbers_sf01(spark):
    """All sf0.1 golden numbers of the fixture campaign in one pass."""
    sf = "/root/testdata/sf0.1"
    d = dashboard(spark, sf, FIXTURE_PARAMS)
    assert (d.impressions().count(), d.clicks().count()) == (199691, 66939)
    r = d.user_days.agg(F.count("*"), F.sum("impressions"), F.sum("clicks")).collect()[0]
    assert list(r) == [75423, 200875, 62863]
    assert dashboard(spark, sf, FIXTURE_PARAMS.with_line_items(LINE_ITEM_IDS)).user_days.count() == 37726
    z = d.z_test_high_band().collect()[0]
    assert (z.clicks_1, z.impressions_1, z.clicks_2, z.impressions_2) == (3805, 11966, 3774, 12032)
    assert round(z.z, 9) == 0.719959812 and round(z.p_value, 9) == 0.47154974
    c = d.score_correlation().collect()[0]
    assert c.n_users == 7486 and round(c.correlation, 9) == 0.008369346
    cells = d.overlap_by_decile()
    assert cells.count() == 121 and cells.filter("tid1Decile is null or tid2Decile is null").count() == 21
    un = {r.tid: (r.clicks, r.impressions, r.ctr) for r in d.ctr_by_decile([FIXTURE_PARAMS.model1]).collect() if r.decile is None}
    assert un == {"1-URGENT": (309, 1002, 30.84), None: (50149, 160381, 31.27)}
