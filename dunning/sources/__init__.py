"""Sources: the eight report tables from Parquet, JDBC or the driver fixture."""

from dunning.sources.tables import Tables, from_catalog, from_fixture, from_jdbc, from_parquet

__all__ = ["Tables", "from_catalog", "from_fixture", "from_jdbc", "from_parquet"]
