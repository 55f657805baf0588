"""Score attachment and click-through rate by decile and by band.

All requested models are scored in one pass over the user-day frame: the
user-days meet the (deduplicated) score rows of every model in one left join,
and each model still gets its own "unscored" row (user-days it did not score),
exactly what a separate left join per model would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.constants import BANDS, CTR_PERCENT_COLUMN, DECILES
from liftlens.functions.columns import band, count_label, ctr_percent, ctr_percent_safe
from liftlens.functions.columns import in_window
from liftlens.functions.labels import two_digits
from liftlens.operators.prefilter import FILTER_WORDS, mark_listed
from liftlens.params import Params


def prepare_scores(scores: DataFrame, p: Params, models=None, users: DataFrame | None = None, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Score rows of ``models`` inside the date window, exact duplicate rows
    removed (rows that differ in any column, e.g. only in ``score``, stay).

    The distinct is a two-phase aggregate: copies collapse map-side before the
    shuffle, so a row repeated a billion times costs one row per map task. With
    ``users`` (user-days), scores of other users are dropped at the scan by a
    filter of fixed size; it may let some through, which no user-day meets.
    """
    models = list(models if models is not None else p.models)
    kept = scores.filter(in_window("date", p) & F.col("tid").isin(models))
    if users is not None:
        kind = scores.schema["xid"].dataType
        exposed = users.select(F.col("xid_imp").try_cast(kind).alias("xid"))
        kept = mark_listed(kept, exposed, ["xid"], "_exposed", filter_words).filter("_exposed").drop("_exposed")
    return kept.dropDuplicates()


def _models_frame(spark: SparkSession, models) -> DataFrame:
    distinct = list(dict.fromkeys(models))
    return spark.createDataFrame([(m,) for m in distinct], "model string")


# Deciles with a counter of their own; slot 0 is a missing decile.
SLOTS = (None, *DECILES)


def score_counts(scores_dedup: DataFrame, models) -> DataFrame:
    """One row per ``(s_xid, s_date)``: ``n_<model>_<slot>`` counts the distinct
    score rows of a model and decile (slot 0: no decile), ``n_<model>`` all of the
    model's. ``models`` are positions in the list of requested ids.

    Counters are conditional aggregates, so a row is bounded by models x deciles
    and a placeholder user id with a third of all score rows collapses map-side
    into one row per task before its only shuffle.
    """
    counters = []
    for i, m in enumerate(models):
        mine = f"tid = {_id(m, scores_dedup)}"
        counters.append(F.expr(f"count_if({mine})").alias(f"n_{i}"))
        for j, d in enumerate(SLOTS):
            counters.append(F.expr(f"count_if({mine} and decile {'is null' if d is None else f'= {d}'})").alias(f"n_{i}_{j}"))
    return scores_dedup.groupBy(F.col("xid").alias("s_xid"), F.col("date").alias("s_date")).agg(*counters)


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _id(model: str, scores: DataFrame) -> str:
    """A requested id as a value of the id column; NULL if it cannot be one."""
    return f"try_cast({_text(model)} as {scores.schema['tid'].dataType.simpleString()})"


def decile_sums(user_days: DataFrame, scores_dedup: DataFrame, models) -> DataFrame:
    """Impressions and clicks per ``(model, tid, decile)``.

    For model m: rows with ``tid = m`` for every decile it assigned (a user-day
    with several distinct score rows counts once per row), and one row with
    ``tid`` and ``decile`` NULL for the user-days m did not score -- what a
    separate left join of the user-days with m's scores gives, for all models
    in one pass. A user-day may come in several rows (the rollups of several
    campaigns, say); they are summed first. Requested ids are compared as
    values of the type of ``tid`` and named as requested.

    User-days meet their score counters one to one. Deciles outside 1 to 10, which
    have no counter, are counted by value in a branch of their own, whose
    condition reaches the score scan; it is empty on regular scores.
    """
    models = list(dict.fromkeys(models))
    user_days = user_days.groupBy("xid_imp", "date").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )
    # xid first, then date: the key order of the user-day grouping.
    meets = (F.col("xid_imp") == F.col("s_xid")) & (F.col("date") == F.col("s_date"))
    joined = user_days.join(score_counts(scores_dedup, models), meets, "left")
    kinds = {c: scores_dedup.schema[c].dataType.simpleString() for c in ("tid", "decile")}

    def cell(model: str, tid: str, decile, n: str) -> str:
        decile = "null" if decile is None else decile
        return f"named_struct('model', {_text(model)}, 'tid', {tid}, 'decile', cast({decile} as {kinds['decile']}), 'n_rows', {n})"

    cells = []
    for i, m in enumerate(models):
        cells.append(cell(m, f"cast(null as {kinds['tid']})", None, f"if(coalesce(n_{i}, 0) = 0, 1L, 0L)"))  # not scored
        cells += [cell(m, _id(m, scores_dedup), d, f"n_{i}_{j}") for j, d in enumerate(SLOTS)]
    counted = joined.selectExpr("impressions", "clicks", f"inline(filter(array({', '.join(cells)}), c -> c.n_rows > 0))")
    other = scores_dedup.filter(~F.col("decile").isin(list(DECILES)))
    other = other.groupBy(F.col("xid").alias("s_xid"), F.col("date").alias("s_date"), "tid", "decile").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = ", ".join(f"named_struct('model', {_text(m)}, 'of', {_id(m, scores_dedup)})" for m in models)
    met = user_days.join(other, meets).selectExpr("impressions", "clicks", "tid", "decile", "n_rows", f"inline(filter(array({asked}), a -> a.of = tid))")
    rows = counted.union(met.select(*counted.columns))
    return rows.groupBy("model", "tid", "decile").agg(
        F.expr("sum(impressions * n_rows)").alias("impressions"), F.expr("sum(clicks * n_rows)").alias("clicks")
    )


def ctr_by_decile(user_days: DataFrame, scores_dedup: DataFrame, models) -> DataFrame:
    """``model, tid, decile, impressions, clicks, ctr`` (ctr in percent, 2 places)."""
    return decile_sums(user_days, scores_dedup, models).withColumn("ctr", ctr_percent())


def ctr_by_band(decile_frame: DataFrame) -> DataFrame:
    """Re-aggregate decile rows into H / M / L / Unscored bands per ``(model, tid)``;
    CTR is recomputed from the summed counts."""
    return (
        decile_frame.withColumn("DecileGroup", band("decile"))
        .groupBy("model", "tid", "DecileGroup")
        .agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
        .withColumn("ctr", ctr_percent())
    )


def _dense(frame: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    # ``frame`` holds at most one row per (model, key) of the spine, so the
    # broadcast side is bounded by the spine size (models x 10 or x 3).
    cells = frame.filter(F.col("tid").isNotNull()).select("model", key, "impressions", "clicks")
    dense = spine.join(F.broadcast(cells), ["model", key], "left").select(
        "model",
        key,
        F.coalesce(F.col("impressions"), F.lit(0)).cast("bigint").alias("impressions"),
        F.coalesce(F.col("clicks"), F.lit(0)).cast("bigint").alias("clicks"),
        ctr_percent_safe().alias("ctr"),
    )
    # Heatmap cell text: the CTR with two significant digits and a percent sign.
    return dense.withColumn("ctr_label", F.concat(two_digits("ctr"), F.lit(" %")))


def ctr_by_decile_dense(decile_frame: DataFrame, models) -> DataFrame:
    """Exactly ten rows per model (deciles 1-10), zero-filled; unscored rows dropped."""
    spark = decile_frame.sparkSession
    spine = _models_frame(spark, models).select(
        "model", F.explode(F.array(*[F.lit(d) for d in DECILES])).alias("decile")
    )
    frame = decile_frame.filter(F.col("decile").between(DECILES[0], DECILES[-1]))
    return _dense(frame, spine, "decile")


def ctr_by_band_dense(band_frame: DataFrame, models) -> DataFrame:
    """Exactly three rows per model (H, M, L), zero-filled; unscored rows dropped."""
    spark = band_frame.sparkSession
    spine = _models_frame(spark, models).select(
        "model", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("DecileGroup")
    )
    frame = band_frame.filter(F.col("DecileGroup").isin(list(BANDS)))
    return _dense(frame, spine, "DecileGroup")


def _report(frame: DataFrame, key: str, models) -> DataFrame:
    """A range-partitioned sort, so that a report of any number of models is
    written by several tasks; ``model_no`` and the key hold the order, which files
    and readers need not."""
    model_no = None
    for n, m in enumerate(dict.fromkeys(models), start=1):
        here = F.col("model") == F.lit(m)
        model_no = F.when(here, F.lit(n)) if model_no is None else model_no.when(here, F.lit(n))
    return frame.select(
        model_no.alias("model_no"),
        "model",
        key,
        count_label("impressions").alias("impressions"),
        count_label("clicks").alias("clicks"),
        F.col("ctr").alias(CTR_PERCENT_COLUMN),
    ).orderBy("model_no", key)


def ctr_by_decile_report(decile_frame: DataFrame, models) -> DataFrame:
    """Display form: ``model_no, model, decile, impressions, clicks, ctr %`` with
    thousands separators, ``tid`` dropped, ordered by the place of the model in
    ``models`` and by decile (unscored first)."""
    return _report(decile_frame, "decile", models)


def ctr_by_band_report(band_frame: DataFrame, models) -> DataFrame:
    """Display form of the band table, ordered by model and band."""
    return _report(band_frame, "DecileGroup", models)
