"""Scalar column expressions: user id lookup, CTR, banding and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlens.constants import (
    BAND_HIGH,
    BAND_LOW,
    BAND_MEDIUM,
    BAND_UNSCORED,
    HIGH_MAX_DECILE,
    LOW_MIN_DECILE,
    MEDIUM_MAX_DECILE,
    MEDIUM_MIN_DECILE,
    USER_ID_KEY,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def user_id(targeting="CustomTargeting", key: str = USER_ID_KEY) -> Column:
    """User id carried in the targeting map; NULL when the key is absent."""
    return _col(targeting)[key]


def ctr_percent(clicks="clicks", impressions="impressions") -> Column:
    """Click-through rate in percent, rounded to two places (half up)."""
    return F.round(_col(clicks) / _col(impressions) * F.lit(100), 2)


def ctr_percent_safe(clicks="clicks", impressions="impressions") -> Column:
    """As :func:`ctr_percent` but NULL instead of an error for no impressions."""
    return F.round(F.try_divide(_col(clicks), _col(impressions)) * F.lit(100), 2)


def band(decile="decile") -> Column:
    """H / M / L band of a decile; NULL or out-of-band values are unscored."""
    d = _col(decile)
    return (
        F.when(d <= HIGH_MAX_DECILE, F.lit(BAND_HIGH))
        .when(d.between(MEDIUM_MIN_DECILE, MEDIUM_MAX_DECILE), F.lit(BAND_MEDIUM))
        .when(d >= LOW_MIN_DECILE, F.lit(BAND_LOW))
        .otherwise(F.lit(BAND_UNSCORED))
    )


def count_label(n) -> Column:
    """Count with thousands separators, e.g. ``12,345``."""
    return F.format_number(_col(n), 0)


def percent_label(fraction) -> Column:
    """Fraction as a whole percent, e.g. ``0.125 -> '12%'`` (half even);
    NULL stays NULL."""
    return F.concat(F.format_number(_col(fraction) * F.lit(100), 0), F.lit("%"))


def in_window(column, p) -> Column:
    """``column`` (a date, a timestamp or ISO date text) falls in the inclusive
    date window of ``p``. The column is compared as a date, so a timestamp keeps
    its whole last day and unpadded text compares by value. On a date column the
    cast is a no-op that the optimizer drops, so the predicate still reaches
    the scan and prunes partitions."""
    return _col(column).cast("date").between(F.lit(p.start_date), F.lit(p.end_date))
