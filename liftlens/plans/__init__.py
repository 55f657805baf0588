"""Plans: the dashboard as one shared plan, the query registry and the DuckDB
oracle texts."""

from liftlens.plans.dashboard import Dashboard, single_model
from liftlens.plans.queries import DEFAULT_PARAMS, QUERIES, dashboard

__all__ = ["Dashboard", "single_model", "DEFAULT_PARAMS", "QUERIES", "dashboard"]
