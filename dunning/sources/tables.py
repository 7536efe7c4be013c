"""The eight input tables as one bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.schema import OPTIONAL, SCHEMAS


@dataclass(frozen=True)
class Tables:
    """``hist_day``: the column of ``hist`` that holds the day of ``data_at``, for tables
    stored by event day. Only whoever stored the table knows it; it is never guessed.

    ``contract_facts``: what the contact lists say of contracts, if it has been worked out
    before (``plans.shared``)."""

    cadastros: DataFrame
    fones: DataFrame
    acordos: DataFrame
    receber: DataFrame
    rec_comp: DataFrame
    bens: DataFrame
    hist: DataFrame
    stcob: DataFrame
    hist_day: str | None = None
    contract_facts: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.hist_day is not None and self.hist_day not in self.hist.columns:
            raise ValueError(f"hist_tb has no day column {self.hist_day!r}")

    def by_name(self) -> dict[str, DataFrame]:
        return {f"{f.name}_tb": getattr(self, f.name) for f in fields(self) if f"{f.name}_tb" in SCHEMAS}


def _conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in order, cast to the declared types, then any further
    columns as they are. A column that only the fixture has may be missing."""
    declared = [f for f in SCHEMAS[name].fields if f.name not in OPTIONAL or f.name in df.columns]
    extra = [c for c in df.columns if c not in SCHEMAS[name].fieldNames()]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared], *[F.col(f"`{c}`") for c in extra])


def from_parquet(spark: SparkSession, root: str, hist_day: str | None = None, may_be_empty: Collection[str] = ()) -> Tables:
    """Read ``<root>/<table>`` (a Parquet file or folder) with explicit schemas.

    ``hist_day`` names the column by whose event day ``hist_tb`` is stored, so that the
    windows prune files. A folder without data files is an error, as a failed load
    leaves one, unless the table is listed in ``may_be_empty``.
    """
    dfs = {}
    for name, schema in SCHEMAS.items():
        try:
            df = spark.read.parquet(f"{root}/{name}")
        except AnalysisException as exc:
            if "UNABLE_TO_INFER_SCHEMA" not in str(exc) or name not in may_be_empty:
                raise
            df = spark.createDataFrame([], schema)
            if name == "hist_tb" and hist_day is not None:
                df = df.withColumn(hist_day, F.to_date("data_at"))
        dfs[name] = _conform(df, name)
    return _bundle(dfs, hist_day)


def from_catalog(spark: SparkSession, database: str | None = None, hist_day: str | None = None) -> Tables:
    """Read the tables registered in the session catalog (metastore tables or
    views), e.g. ``database.cadastros_tb``; partition pruning and statistics
    come from the catalog."""
    return _bundle({name: _conform(spark.table(f"{database}.{name}" if database else name), name) for name in SCHEMAS}, hist_day)


@dataclass(frozen=True)
class HashKeys:
    """A table read in ``parts`` by a hash of ``column``, of any type, e.g. a text key without numeric bounds.

    ``hash_sql`` is the database's own function to a whole number (CRC32 in MySQL and MariaDB, and in Spark SQL)."""

    column: str
    parts: int
    hash_sql: str = "CRC32({column})"

    def predicates(self) -> list[str]:
        """One condition a part; every row, null keys too, meets exactly one of them, whatever the hash gives."""
        if self.parts < 2:
            return ["1 = 1"]
        rest = f"MOD({self.hash_sql.format(column=self.column)}, {self.parts})"
        last = f"({self.column} IS NULL OR {rest} NOT BETWEEN 0 AND {self.parts - 2})"
        return [f"({self.column} IS NOT NULL AND {rest} = {k})" for k in range(self.parts - 1)] + [last]


def jdbc_options(
    url: str,
    properties: dict[str, str],
    partitioning: dict[str, tuple[str, int, int, int] | HashKeys] | None = None,
    single_connection: Collection[str] = (),
) -> dict[str, dict[str, str]]:
    """Options of each table's JDBC reader.

    ``partitioning`` maps a table to (column, lower, upper, partitions) or to ``HashKeys``, so that many
    tasks read it. A table that is small enough for one connection, and so for one
    task, must be listed in ``single_connection``; any other is an error.
    """
    partitioning = partitioning or {}
    undecided = sorted(set(SCHEMAS) - set(partitioning) - set(single_connection))
    if undecided:
        raise ValueError(f"give a partitioning, or allow a single connection, for: {', '.join(undecided)}")
    out = {}
    for name in SCHEMAS:
        out[name] = {"url": url, "dbtable": name, **properties}
        if isinstance(partitioning.get(name), tuple):
            column, low, high, parts = partitioning[name]
            out[name] |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def from_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    partitioning: dict[str, tuple[str, int, int, int] | HashKeys] | None = None,
    single_connection: Collection[str] = (),
) -> Tables:
    """Read the tables from a database over JDBC (see ``jdbc_options``).

    Credentials come from ``properties`` (Spark configuration), never a file.
    """
    options = jdbc_options(url, properties, partitioning, single_connection)
    by_hash = {name: keys for name, keys in (partitioning or {}).items() if isinstance(keys, HashKeys)}

    def read(name: str) -> DataFrame:
        if name in by_hash:
            return spark.read.jdbc(url, name, predicates=by_hash[name].predicates(), properties=properties)
        return spark.read.format("jdbc").options(**options[name]).load()

    return _bundle({name: _conform(read(name), name) for name in SCHEMAS})


_FIXTURES: dict[tuple, Tables] = {}


def from_fixture(spark: SparkSession, sf_dir: str) -> Tables:
    """Derive the eight tables from the driver's TPC-H-like parquet files.

    The lazy definitions are built once per session and folder (like views in
    a catalog); every action still reads the parquet files.
    """
    from dunning.sources.fixture import derive

    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _FIXTURES:
        _FIXTURES[key] = _bundle(derive(spark, sf_dir))
    return _FIXTURES[key]


def _bundle(dfs: dict[str, DataFrame], hist_day: str | None = None) -> Tables:
    return Tables(**{name[: -len("_tb")]: dfs[name] for name in SCHEMAS}, hist_day=hist_day)
