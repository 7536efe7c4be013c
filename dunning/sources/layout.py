"""Store the eight tables in the layout the reports read fastest.

* ``hist_tb`` (contact events, the largest table) is partitioned by event day
  (``HIST_PARTITION``), so the 30-day and period windows read only the matching folders.
  Readers are told so: ``from_parquet(..., hist_day=HIST_PARTITION)``.
* Tables whose ``cod_cli`` is the portfolio code (registrations, agreements,
  instalments, complements, assets) are partitioned by it, so the portfolio
  filter every report applies skips the other portfolios' folders.

Partitioned writes are rebalanced on the partition column: AQE merges small
groups into few files and splits a large one (a busy day, a portfolio holding
a third of all rows) into several tasks of the advisory partition size, so no
single task writes a whole partition. ``max_records_per_file`` caps file
size; ``files`` spreads the unpartitioned tables over that many files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from dunning.sources.tables import Tables

HIST_PARTITION = "event_day"
PORTFOLIO_PARTITIONED = ("cadastros_tb", "acordos_tb", "receber_tb", "rec_comp_tb", "bens_tb")


#: Keys by which ``write_bucketed`` lays the large tables out: those of the reports' first aggregate or window.
BUCKETED: dict[str, tuple[str, ...]] = {
    "cadastros_tb": ("cod_cad",),
    "fones_tb": ("cod_cad",),
    "receber_tb": ("nmcont", "cod_cli"),
    "rec_comp_tb": ("nmcont", "cod_cli"),
    "bens_tb": ("nmcont", "cod_cli"),
}


def write_bucketed(t: Tables, database: str, buckets: int, keys: Mapping[str, Sequence[str]] = BUCKETED, mode: str = "overwrite") -> None:
    """Store the tables in the catalog, the large ones dealt into ``buckets`` by key and sorted: ``from_catalog`` reads them.

    What is grouped or numbered by such a key (phones of a registration, instalments and assets of a
    contract) then needs no exchange. Bucket numbers should give files of some hundred MB. A key that
    holds much of a table is one file of its bucket, which one task reads: keep such a table in the
    layout of ``write_tables`` instead, by leaving it out of ``keys``. ``hist_tb`` is partitioned by event day, as there.
    """
    for name, df in t.by_name().items():
        to = f"{database}.{name}"
        if name in keys:
            df.repartition(buckets, *keys[name]).write.mode(mode).bucketBy(buckets, *keys[name]).sortBy(*keys[name]).saveAsTable(to)
        elif name == "hist_tb":
            days = df.withColumn(HIST_PARTITION, F.to_date("data_at"))
            days.hint("rebalance", HIST_PARTITION).write.mode(mode).partitionBy(HIST_PARTITION).saveAsTable(to)
        else:
            df.write.mode(mode).saveAsTable(to)


def write_tables(
    t: Tables,
    root: str,
    files: int | None = None,
    max_records_per_file: int | None = None,
    mode: str = "overwrite",
) -> None:
    for name, df in t.by_name().items():
        out = f"{root}/{name}"
        opts = {"maxRecordsPerFile": str(max_records_per_file)} if max_records_per_file else {}
        if name == "hist_tb":
            df = df.withColumn(HIST_PARTITION, F.to_date("data_at"))
            part = HIST_PARTITION
        elif name in PORTFOLIO_PARTITIONED:
            part = "cod_cli"
        else:
            part = None
        if part is not None:
            df.hint("rebalance", part).write.mode(mode).options(**opts).partitionBy(part).parquet(out)
            continue
        if files:
            df = df.repartition(files)
        df.write.mode(mode).options(**opts).parquet(out)
