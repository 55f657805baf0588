"""Plan shape: the properties that make the queries hold at scale.

Checked on the physical plans Spark produces for the registered queries, with
automatic broadcast joins off so the plans look like they would on logs far
larger than any broadcast threshold.
"""

import re

import pytest

import __spark_entry__ as E
from liftlens.plans.dashboard import Dashboard
from liftlens.plans.queries import QUERIES
from tests.conftest import SF0001


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_or_row_udf_operators(no_broadcast, name):
    plan = _plan(E.queries()[name](no_broadcast, SF0001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name} plans {bad}"


def _exchanges(plan: str, of: str) -> list[str]:
    """Exchanges on keys that begin with ``of``; a reused one is named once more, without its children."""
    return re.findall(rf"- Exchange hashpartitioning\((?:{of})[^\n]*", plan)


def test_scores_are_shuffled_twice(no_broadcast):
    """Once to drop copies and once as counters to the user-days, whose own
    partitioning the join keeps."""
    t, p = _standins(no_broadcast)
    plan = _plan(Dashboard(t, p).ctr_by_decile())
    assert len(_exchanges(plan, r"xid#\d+, date#\d+, \d+\)")) == 1  # the counters
    assert len(re.findall(r"- Exchange hashpartitioning\([^\n]*score#", plan)) == 1  # the distinct
    assert len(_exchanges(plan, r"xid_imp#\d+, date#\d+, \d+\)")) == 1  # the user-days, for the rollup and the join
    assert "SortMergeJoin [xid_imp" in plan
    assert "ObjectHashAggregate" not in plan and "collect_" not in plan


def test_click_match_plan(no_broadcast):
    """One exchange of the impressions, both logs in it, and no join of the two:
    the branch of rows without a serve and the one with it read the same exchange."""
    from liftlens.operators import events

    t, p = _standins(no_broadcast)
    plan = _plan(events.user_days(t.impressions, t.clicks, p))
    assert len(_exchanges(plan, r"xid_imp#\d+, date#\d+, serve")) == 1
    assert plan.count("ReusedExchange") >= 1
    assert len(_exchanges(plan, r"xid_imp#\d+, date#\d+, \d+\)")) == 1
    # joins: those of the stand-ins (lineitem with orders) and the lookup in the filter of fixed size
    assert all("orderkey" in j or "xxhash64" in j for j in re.findall(r"Join \[[^\n]*", plan))


def test_joined_logs_are_matched_where_they_are(no_broadcast):
    """Both stand-in logs come out of a join on the ad unit: no serve key is
    exchanged after it, the user-days once, and a serve's window needs no exchange."""
    t, p = _standins(no_broadcast)
    plan = _plan(Dashboard(t, p).user_days)
    assert not re.findall(r"- Exchange [^\n]*serve#", plan)
    assert len(_exchanges(plan, "xid_imp")) == 1
    assert "Window [sum(n_clicks" in plan


def test_counts_of_the_logs_are_read_once(no_broadcast):
    from liftlens.operators import events

    t, p = _standins(no_broadcast)
    plan = _plan(events.user_days(t.impressions, t.clicks, p))
    assert not re.findall(r"ReusedExchange \[xid_imp", plan)


def _standins(spark):
    from liftlens.plans.queries import DEFAULT_PARAMS
    from liftlens.sources.standins import standin_tables

    return standin_tables(spark, SF0001), DEFAULT_PARAMS


def test_materialized_rollup_keeps_its_partitioning(no_broadcast):
    """The score join reads the bucketed rollup without an exchange."""
    t, p = _standins(no_broadcast)
    d = Dashboard(t, p).materialize()
    try:
        lazy = Dashboard(t, p)
        lazy._user_days = d.user_days
        plan = _plan(lazy.ctr_by_decile())
        assert "Bucketed: true" in plan and "SortMergeJoin [xid_imp" in plan
        assert not _exchanges(plan, "xid_imp")
        assert d._overlap.count() <= 121
    finally:
        d.release()
    assert d._rollup_table is None


@pytest.mark.parametrize("name", ["ctr_by_decile_models", "clicks_impressions_by_user_day", "z_test_high_band"])
def test_building_a_query_runs_no_job_on_the_logs(spark, name):
    """Only reading Parquet schemas may start jobs."""
    before = _jobs(spark, lambda: [spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("orders", "lineitem")])
    E.queries()[name](spark, SF0001)
    again = _jobs(spark, lambda: E.queries()[name](spark, SF0001))
    assert again <= before


def _jobs(spark, build) -> int:
    sc = spark.sparkContext
    sc.setJobGroup("count-jobs", "")
    seen = len(sc.statusTracker().getJobIdsForGroup("count-jobs"))
    build()
    sc.setJobGroup(None, None)
    return len(sc.statusTracker().getJobIdsForGroup("count-jobs")) - seen


def test_overlap_pairs_need_one_shuffle_and_no_join(no_broadcast):
    plan = _plan(E.queries()["score_correlation"](no_broadcast, SF0001))
    assert "Join" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(xid#\d+, \d+\)", plan)) == 1


def test_log_filters_are_pushed_to_the_scan(no_broadcast):
    plan = _plan(E.queries()["impressions_filtered"](no_broadcast, SF0001))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
