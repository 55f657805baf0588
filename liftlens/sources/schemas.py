"""Declared schemas of the five inputs.

The analysed notebook reads catalog tables without declaring anything; these
are the weakest types that make every use legal. ``check_columns`` verifies a
frame carries the columns an operator needs before any job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from liftlens.constants import SERVE_KEYS

# One row per ad serve (impression log) or per click (click log).
DELIVERY_LOG = T.StructType(
    [
        T.StructField("logdate", T.DateType()),
        T.StructField("OrderId", T.LongType()),
        T.StructField("LineItemId", T.LongType()),
        T.StructField("CreativeId", T.IntegerType()),
        T.StructField("CreativeVersion", T.IntegerType()),
        T.StructField("CreativeSize", T.StringType()),
        T.StructField("AdUnitId", T.LongType()),
        T.StructField("CityId", T.IntegerType()),
        T.StructField("Time", T.TimestampNTZType()),
        T.StructField("TimeUsec", T.LongType()),
        T.StructField("Product", T.StringType()),
        T.StructField("AdvertiserId", T.StringType()),
        T.StructField("CustomTargeting", T.MapType(T.StringType(), T.StringType())),
    ]
)

# One row per (user, day, model) score.
SCORES = T.StructType(
    [
        T.StructField("xid", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("tid", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("decile", T.IntegerType()),
    ]
)

LINE_ITEMS = T.StructType(
    [
        T.StructField("orderId", T.LongType()),
        T.StructField("orderName", T.StringType()),
        T.StructField("creationDateTime", T.TimestampNTZType()),
    ]
)

SEGMENT_TRAIT = T.StructType(
    [
        T.StructField("trait_id", T.StringType()),
        T.StructField("segment_name", T.StringType()),
    ]
)

SALARY = T.StructType(
    [
        T.StructField("YearsExperience", T.DoubleType()),
        T.StructField("Salary", T.DoubleType()),
    ]
)

LOG_COLUMNS = ("logdate", *SERVE_KEYS, "CustomTargeting")
SCORE_COLUMNS = ("xid", "date", "tid", "score", "decile")


def check_columns(df: DataFrame, required, what: str) -> None:
    """Raise a clear error when ``df`` lacks a column an operator needs."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; it has {sorted(have)}")
