"""Order and segment name lookups."""

import datetime as dt

from liftlens.operators import names

LI = "orderId bigint, orderName string, creationDateTime timestamp_ntz"


def test_order_names_first_created_nulls_first_duplicates_unknown(spark):
    li = spark.createDataFrame(
        [
            (1, "late", dt.datetime(2020, 1, 2)),
            (1, "early", dt.datetime(2020, 1, 1)),
            (2, "dated", dt.datetime(2019, 1, 1)),
            (2, "undated", None),
            (3, "b", dt.datetime(2020, 1, 1)),
            (3, "a", dt.datetime(2020, 1, 1)),
        ],
        LI,
    )
    got = [(r.orderId, r.Orders_Analyzed) for r in names.order_names(li, [1, 2, 9, 1, 3]).collect()]
    assert got == [(1, "early"), (2, "undated"), (9, None), (1, "early"), (3, "a")]


def test_segment_names(spark):
    st = spark.createDataFrame([("t1", "Z name"), ("t1", "A name"), ("t2", "Other")], "trait_id string, segment_name string")
    got = sorted(tuple(r) for r in names.segment_names(st, ["t1", "t2"]).collect())
    assert got == [(1, "t1", "A name", "Model 1: A name"), (2, "t2", "Other", "Model 2: Other")]


def test_scores_preview_is_ordered_and_limited(spark):
    sc = spark.createDataFrame([(f"x{i % 7}", i) for i in range(50)], "xid string, n int")
    got = [tuple(r) for r in names.scores_preview(sc, 5).collect()]
    assert got == sorted((f"x{i % 7}", i) for i in range(50))[:5]


def test_unordered_preview_takes_n_rows(spark):
    sc = spark.createDataFrame([(f"x{i}", i) for i in range(50)], "xid string, n int")
    assert names.scores_preview(sc, 7, ordered=False).count() == 7
