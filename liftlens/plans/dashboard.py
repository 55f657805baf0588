"""The dashboard as one plan: every report is derived from a shared user-day
frame and a shared deduplicated score frame, so the log join is planned once
(the analysed notebook re-ran it for each of its twelve displays and fetches).

Call :meth:`Dashboard.materialize` before pulling several reports: it writes
the user-day rollup as a table bucketed by user and day to the shared folder, so
that the score join needs no exchange of it, and checkpoints the decile sums and
the overlap state, a few rows each. That cuts the lineage (losing an executor
later never re-runs the log match or the score scans).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.operators import events, lift, names, overlap, significance
from liftlens.operators.prefilter import FILTER_WORDS
from liftlens.params import Params
from liftlens.plans.publish import Run, latest_run, publish
from liftlens.session import delete_path, ensure_checkpoint_dir
from liftlens.sources.catalog import Tables


class Dashboard:
    """``filter_words`` is the size of the two Bloom filters in 64-bit words (a
    power of two): clicked serves at the impression scan, exposed users at the
    score scan. It changes the work, never a result."""

    def __init__(self, tables: Tables, params: Params, filter_words: int = FILTER_WORDS):
        self.tables = tables
        self.p = params
        self.filter_words = filter_words
        self._rollup_table: tuple[str, str] | None = None
        self._user_days: DataFrame | None = None
        self._deciles: DataFrame | None = None
        self._overlap: DataFrame | None = None

    # -- delivery logs ---------------------------------------------------
    def impressions(self) -> DataFrame:
        return events.impressions_filtered(self.tables.impressions, self.p)

    def clicks(self) -> DataFrame:
        return events.clicks_filtered(self.tables.clicks, self.p)

    @property
    def user_days(self) -> DataFrame:
        if self._user_days is None:
            self._user_days = events.rollup_user_day(
                self.impressions(), self.clicks(), self.filter_words, self.tables.together
            )
        return self._user_days

    def materialize(self) -> "Dashboard":
        """Write the user-day rollup as a bucketed table, and the decile sums of
        every model and the overlap state as reliable checkpoints, all to the
        shared folder (never executor-local ones). See :meth:`release`."""
        if self._rollup_table is None:
            spark = self.tables.impressions.sparkSession
            name = f"liftlens_user_days_{uuid.uuid4().hex}"
            path = f"{ensure_checkpoint_dir(spark)}/{name}"
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as the score side is dealt into
            self.user_days.write.bucketBy(buckets, "xid_imp", "date").format("parquet").option("path", path).saveAsTable(name)
            self._rollup_table = name, path
            self._user_days = spark.table(name)
            if self.p.models:  # log-only parameters have nothing to score
                self._deciles = self.ctr_by_decile().checkpoint(eager=True)
                self._overlap = self.overlap_state.checkpoint(eager=True)
        return self

    def release(self) -> None:
        """Drop the rollup table and its files; the dashboard is lazy again."""
        if self._rollup_table is not None:
            spark = self.tables.impressions.sparkSession
            name, path = self._rollup_table
            spark.sql(f"drop table if exists {name}")
            delete_path(spark, path)
            self._rollup_table = self._user_days = self._deciles = self._overlap = None

    # -- scores and lift ---------------------------------------------------
    def scores_dedup(self, models=None) -> DataFrame:
        return lift.prepare_scores(self.tables.scores, self.p, models)

    def ctr_by_decile(self, models=None, fresh: bool = False) -> DataFrame:
        """Per model and decile; ``fresh``: from the user-days, also where the sums are kept."""
        models = list(models if models is not None else self.p.models)
        if not fresh and self._deciles is not None and set(models) <= set(self.p.models):
            # each model's rows are independent of the other models scored with it
            return self._deciles.filter(F.col("model").isin(models))
        # scores of unexposed users are left out once the rollup is a table, which is cheap to read again
        users = self.user_days if self._rollup_table is not None else None
        scores = lift.prepare_scores(self.tables.scores, self.p, models, users, self.filter_words)
        return lift.ctr_by_decile(self.user_days, scores, models)

    def ctr_by_band(self, models=None) -> DataFrame:
        return lift.ctr_by_band(self.ctr_by_decile(models))

    def ctr_by_decile_dense(self) -> DataFrame:
        return lift.ctr_by_decile_dense(self.ctr_by_decile(), self.p.models)

    def ctr_by_band_dense(self) -> DataFrame:
        return lift.ctr_by_band_dense(self.ctr_by_band(), self.p.models)

    def ctr_by_decile_report(self) -> DataFrame:
        return lift.ctr_by_decile_report(self.ctr_by_decile(), self.p.models)

    def ctr_by_band_report(self) -> DataFrame:
        return lift.ctr_by_band_report(self.ctr_by_band(), self.p.models)

    def z_test_high_band(self) -> DataFrame:
        models = [self.p.model1, self.p.model2]
        return significance.band_z_test(self.ctr_by_band(models), self.p.model1, self.p.model2, self.p.alpha)

    # -- overlap -----------------------------------------------------------
    def user_best_scores(self) -> DataFrame:
        return overlap.best_scores(self.tables.scores, self.p)

    @property
    def overlap_state(self) -> DataFrame:
        """Model 1 against model 2 in at most 121 rows, for all overlap reports."""
        if self._overlap is None:
            pairs = overlap.best_score_pairs(self.tables.scores, self.p, self.p.model1, self.p.model2)
            self._overlap = overlap.overlap_state(pairs)
        return self._overlap

    def overlap_by_decile(self) -> DataFrame:
        return overlap.overlap_by_decile(self.overlap_state)

    def overlap_by_band(self) -> DataFrame:
        return overlap.overlap_by_band(self.overlap_by_decile())

    def overlap_decile_matrix(self) -> DataFrame:
        return overlap.overlap_decile_matrix(self.overlap_by_decile())

    def overlap_band_matrix(self) -> DataFrame:
        return overlap.overlap_band_matrix(self.overlap_by_band())

    def overlap_decile_wide(self) -> DataFrame:
        return overlap.overlap_decile_wide(self.overlap_decile_matrix())

    def score_correlation(self) -> DataFrame:
        return overlap.score_correlation(self.overlap_state)

    # -- dimensions ----------------------------------------------------------
    def order_names(self) -> DataFrame:
        return names.order_names(self.tables.line_items, self.p.order_ids)

    def segment_names(self) -> DataFrame:
        return names.segment_names(self.tables.segment_trait, [self.p.model1, self.p.model2])

    def scores_preview(self, n: int = 100, ordered: bool = True) -> DataFrame:
        return names.scores_preview(self.tables.scores, n, ordered)


    # -- sink ------------------------------------------------------------------
    REPORTS = (
        "order_names",
        "segment_names",
        "ctr_by_decile_report",
        "ctr_by_band_report",
        "ctr_by_decile_dense",
        "ctr_by_band_dense",
        "z_test_high_band",
        "overlap_by_decile",
        "overlap_by_band",
        "overlap_decile_matrix",
        "overlap_band_matrix",
        "score_correlation",
    )
    # Columns that give the rows of a report their order.
    ORDERS = {
        "ctr_by_decile_report": ("model_no", "decile"),
        "ctr_by_band_report": ("model_no", "DecileGroup"),
        "ctr_by_decile_dense": ("model", "decile"),
        "ctr_by_band_dense": ("model", "DecileGroup"),
        "segment_names": ("model_no",),
        "overlap_by_decile": ("tid1Decile", "tid2Decile"),
        "overlap_by_band": ("DecileGroup1", "DecileGroup2"),
        "overlap_decile_matrix": ("tid1Decile", "tid2Decile"),
        "overlap_band_matrix": ("DecileGroup1", "DecileGroup2"),
    }

    def save(self, path: str, reports=REPORTS) -> dict[str, str]:
        """Publish the reports as one run under ``path`` and return the folder of
        each. A reader of :meth:`saved` sees all of them or the run before.
        Materializes first, so the log match runs once for all reports."""
        self.materialize()
        spark = self.tables.impressions.sparkSession
        run = publish(spark, path, {name: getattr(self, name) for name in reports}, self.ORDERS)
        return run.folders

    def saved(self, path: str) -> Run | None:
        """The newest published run under ``path``."""
        return latest_run(self.tables.impressions.sparkSession, path)


def single_model(frame: DataFrame, model: str) -> DataFrame:
    """The per-model view of a multi-model frame, without the ``model`` column."""
    return frame.filter(F.col("model") == model).drop("model")
