"""liftlens: campaign-lift analytics on Spark DataFrames.

Judges audience-scoring models against ad delivery logs: impressions are
matched to clicks, rolled up per user and day, joined to daily model scores
and reported as click-through rate per score decile and per H/M/L band,
with a two-proportion z-test between models and an overlap analysis of the
users two models score.

The report operators take DataFrames and return lazy DataFrames, and collect
nothing. Materializing and publishing write tables; the training-data operators in
``llm`` write tables and bring bounded values to the driver.
"""

from liftlens.params import Params, parse_id_list

__all__ = ["Dashboard", "Params", "TableNames", "Tables", "parse_id_list", "read_catalog"]


def __getattr__(name):
    # Spark-facing names load on first use, so ``import liftlens`` stays light.
    if name == "Dashboard":
        from liftlens.plans.dashboard import Dashboard

        return Dashboard
    if name in ("TableNames", "Tables", "read_catalog"):
        from liftlens.sources import catalog

        return getattr(catalog, name)
    raise AttributeError(name)
