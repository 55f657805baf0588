"""Readers for the production inputs: catalog tables and the salary CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from liftlens.sources import schemas


@dataclass(frozen=True)
class TableNames:
    """Catalog names of the five inputs; neutral defaults, override per site."""

    impressions: str = "impressions"
    clicks: str = "clicks"
    scores: str = "scores"
    line_items: str = "line_items"
    segment_trait: str = "segment_trait"


@dataclass(frozen=True)
class Tables:
    """The five input frames every report is built from.

    ``together`` names a serve key by which the rows of both logs already lie
    together, if any (see ``operators.events``); a wrong name costs work only.
    """

    impressions: DataFrame
    clicks: DataFrame
    scores: DataFrame
    line_items: DataFrame
    segment_trait: DataFrame
    together: str | None = None

    def validate(self) -> "Tables":
        schemas.check_columns(self.impressions, schemas.LOG_COLUMNS, "impressions")
        schemas.check_columns(self.clicks, schemas.LOG_COLUMNS, "clicks")
        schemas.check_columns(self.scores, schemas.SCORE_COLUMNS, "scores")
        schemas.check_columns(self.line_items, schemas.LINE_ITEMS.fieldNames(), "line_items")
        schemas.check_columns(self.segment_trait, schemas.SEGMENT_TRAIT.fieldNames(), "segment_trait")
        return self


def read_catalog(spark: SparkSession, names: TableNames = TableNames()) -> Tables:
    """Read the five inputs from the session catalog.

    Tables are expected to be partitioned by ``logdate`` (logs) and ``date``
    (scores) so the date window prunes partitions; the readers only declare
    intent, Catalyst pushes the filters of the operators into the scans.
    """
    return Tables(
        impressions=spark.read.table(names.impressions),
        clicks=spark.read.table(names.clicks),
        scores=spark.read.table(names.scores),
        line_items=spark.read.table(names.line_items),
        segment_trait=spark.read.table(names.segment_trait),
    ).validate()


def read_salary(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV (``YearsExperience,Salary``) with a header line."""
    return spark.read.csv(path, header=True, schema=schemas.SALARY)
