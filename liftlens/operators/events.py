"""Delivery-log operators: campaign filter, click-to-impression matching and
the per user-day rollup.

Matching semantics (kept exactly): every impression is left-joined to every
click with equal serve keys and user id. An impression with k matching clicks
therefore yields max(k, 1) joined rows, each counting one impression, and k
clicks; a NULL key never matches; clicks without an impression are dropped.

Scale design: no join operator and no pair rows. Impressions and clicks go into
one map-side aggregate as a tagged union, so copies of a row collapse before the
only exchange of the impressions. An impression keeps its serve keys there only
if a click may have them, which a Bloom filter of fixed size over the click keys
decides; where clicks are few next to the filter, what crosses the network is one
row per task and user-day, plus one per serve that was clicked (or let through by
chance, which costs work and changes nothing). All rows are then brought together
per serve, to read the number of clicks k; their sums are ``n_imps * max(k, 1)``
impressions and ``n_imps * k`` clicks.

Logs whose rows lie ``together`` by one of the serve keys (bucketed tables, or
what a join on that key gives) are matched where they are: no serve key crosses
the network again, however many clicks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlens.constants import SERVE_KEYS
from liftlens.functions.columns import in_window, user_id
from liftlens.operators.prefilter import FILTER_WORDS, mark_listed
from liftlens.params import Params


# Id lists up to this length are inlined as ``IN`` literals (pushed into the
# Parquet scan); longer ones become a left-semi join with a broadcast frame of
# the ids, whose size is bounded by the list the caller passed.
INLINE_ID_LIMIT = 1000


def _keep_ids(log: DataFrame, column: str, ids, limit: int) -> DataFrame:
    ids = list(dict.fromkeys(ids))
    if len(ids) <= limit:
        return log.filter(F.col(column).isin(ids))
    wanted = log.sparkSession.createDataFrame([(i,) for i in ids], f"{column} bigint")
    return log.join(F.broadcast(wanted), column, "left_semi").select(*log.columns)


def filter_log(log: DataFrame, p: Params, *, inline_limit: int = INLINE_ID_LIMIT) -> DataFrame:
    """Rows of one delivery log inside the campaign window.

    Keeps rows whose order id is requested, whose ``logdate`` lies in the
    inclusive date window, whose line item is requested (only when line item
    ids are given) and that carry a user id; adds that id as ``xid``. The
    predicates are column comparisons with literals, so they reach the Parquet
    scan (and partition pruning on ``logdate``); very long id lists are applied
    as a broadcast semi join instead.
    """
    log = log.filter(in_window("logdate", p))
    log = _keep_ids(log, "OrderId", p.order_ids, inline_limit)
    if p.line_item_ids:
        log = _keep_ids(log, "LineItemId", p.line_item_ids, inline_limit)
    return log.withColumn("xid", user_id("CustomTargeting", p.user_key)).filter(F.col("xid").isNotNull())


def impressions_filtered(impressions: DataFrame, p: Params) -> DataFrame:
    """One row per impression: serve keys, ``date``, ``xid_imp``, ``impressions = 1``."""
    return filter_log(impressions, p).select(
        *SERVE_KEYS,
        F.col("logdate").alias("date"),
        F.col("xid").alias("xid_imp"),
        F.lit(1).alias("impressions"),
    )


def clicks_filtered(clicks: DataFrame, p: Params) -> DataFrame:
    """One row per click: serve keys, ``logdate``, ``xid``, ``clicks = 1``."""
    return filter_log(clicks, p).select(*SERVE_KEYS, "logdate", "xid", F.lit(1).alias("clicks"))


def _typed_as(log: DataFrame, column: str, like: DataFrame, other: str) -> Column:
    """``column`` in the type that ``like`` has for it; a value that type cannot
    hold equals none of its values and becomes NULL."""
    kind = like.schema[other].dataType
    return F.col(column) if log.schema[column].dataType == kind else F.col(column).try_cast(kind)


def _apart(together: str | None) -> list[str]:
    """The serve key that stays a column of its own, so that Spark sees the layout by it."""
    if together is None:
        return []
    if together not in SERVE_KEYS:
        raise ValueError(f"logs lie together by one of {SERVE_KEYS}, got {together!r}")
    return [together]


def serve_counts(
    imps_f: DataFrame, clicks_f: DataFrame, filter_words: int = FILTER_WORDS, together: str | None = None
) -> DataFrame:
    """``xid_imp, date, serve, n_imps, n_clicks, keyed``: both logs in one map-side
    aggregate. ``serve`` is NULL for impressions that no click can match; clicks
    have a ``serve`` and the same early ``date``. A NULL among the keys never matches.
    With ``together`` that key is a column of all rows and not part of ``serve``."""
    apart = _apart(together)
    clicks = clicks_f.select(
        *(_typed_as(clicks_f, k, imps_f, k).alias(k) for k in SERVE_KEYS), _typed_as(clicks_f, "xid", imps_f, "xid_imp").alias("xid_imp")
    ).dropna()
    serve = F.struct(*(k for k in SERVE_KEYS if k not in apart))
    marked = mark_listed(imps_f, clicks, [*SERVE_KEYS, "xid_imp"], "_clicked", filter_words)
    imps = marked.select("xid_imp", "date", *apart, F.when(F.col("_clicked"), serve).alias("serve"), F.lit(1).alias("imp"), F.lit(0).alias("click"))
    no_day = F.lit("0001-01-01").cast(imps_f.schema["date"].dataType)  # not NULL, so that a filter on dates keeps the clicks
    clks = clicks.select("xid_imp", no_day.alias("date"), *apart, serve.alias("serve"), F.lit(0).alias("imp"), F.lit(1).alias("click"))
    return imps.unionByName(clks).groupBy("xid_imp", "date", *apart, "serve").agg(
        F.sum("imp").alias("n_imps"), F.sum("click").alias("n_clicks"), F.max(F.col("serve").isNotNull()).alias("keyed")
    )


def rollup_user_day(
    imps_f: DataFrame, clicks_f: DataFrame, filter_words: int = FILTER_WORDS, together: str | None = None
) -> DataFrame:
    """Impressions and clicks per user-day: ``xid_imp, date, impressions, clicks``.

    Equal to summing the left outer join of impressions with clicks on all
    serve keys and the user id (see module doc), without emitting its pairs.

    One plan at any size, and no job while it is built. Rows without a serve take
    the same way, so what was exchanged is read once; no click is among them and
    their k is 0. A serve's rows are its clicks and one row per day, and those of a
    user without a serve one row per day, so no window grows with the log.
    ``together``: see the module doc; it changes the work, never a result.
    """
    counts = serve_counts(imps_f, clicks_f, filter_words, together)
    k = F.sum("n_clicks").over(Window.partitionBy("xid_imp", *_apart(together), "serve"))
    matched = counts.withColumn("k", k).filter("n_imps > 0").select(
        "xid_imp",
        "date",
        (F.col("n_imps") * F.greatest("k", F.lit(1))).alias("impressions"),
        (F.col("n_imps") * F.col("k")).alias("clicks"),
    )
    return matched.groupBy("xid_imp", "date").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )


def user_days(impressions: DataFrame, clicks: DataFrame, p: Params) -> DataFrame:
    """Filter both logs with ``p`` and roll them up per user-day."""
    return rollup_user_day(impressions_filtered(impressions, p), clicks_filtered(clicks, p))
