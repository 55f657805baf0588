"""Sources: declared schemas, catalog readers, the CSV reader and the
stand-in tables derived from the test data."""

from liftlens.sources.catalog import Tables, TableNames, read_catalog, read_salary
from liftlens.sources.standins import standin_tables, duckdb_prelude

__all__ = ["Tables", "TableNames", "read_catalog", "read_salary", "standin_tables", "duckdb_prelude"]
