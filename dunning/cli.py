"""Command line: pick portfolios and a report, write the result.

    python -m dunning --tables /data/receivables --report r05_cpc_period \\
        --portfolios 517,518 --start 2025-08-15 --end 2025-08-20 --out /data/out

(on a cluster: ``spark-submit --py-files dunning.zip dunning/__main__.py ...``)

``--source fixture`` derives the tables from the driver's TPC-H-like folder
instead of reading stored tables. ``--source jdbc`` reads a database: ``--tables`` is
its JDBC url, ``--jdbc-option`` gives reader options (the password better comes from
``--jdbc-option password-conf=<spark conf key>``), and every table needs either
``--jdbc-partition table:column:lower:upper:parts``, ``--jdbc-hash table:column:parts`` (keys of
any type) or ``--jdbc-single table``. Several reports may be named, separated by commas; what contact lists share
is then worked out once, in a folder beside the results. Prints the row count and the output folder of each.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from dunning.fixed import PHONE_SLOTS, PORTFOLIOS
from dunning.functions.scalars import parse_money_text
from dunning.params import ReportParams
from dunning.plans.reports import REPORTS
from dunning.plans.shared import with_shared_facts
from dunning.session import configure
from dunning.sinks.files import write_report
from dunning.sources.tables import HashKeys, Tables, from_catalog, from_fixture, from_jdbc, from_parquet


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="dunning", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--list", action="store_true", help="list the reports and exit")
    ap.add_argument("--tables", help="folder with the eight tables (or the driver folder with --source fixture)")
    ap.add_argument("--source", choices=["parquet", "catalog", "jdbc", "fixture"], default="parquet",
                    help="parquet: folder per table; catalog: --tables names the database; jdbc: --tables is the url; fixture: driver folder")
    ap.add_argument("--hist-day", help="column by whose event day hist_tb is stored (parquet, catalog)")
    ap.add_argument("--may-be-empty", default="", help="comma-separated tables whose folder may hold no data file (parquet)")
    ap.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE")
    ap.add_argument("--jdbc-partition", action="append", default=[], metavar="TABLE:COLUMN:LOWER:UPPER:PARTS")
    ap.add_argument("--jdbc-hash", action="append", default=[], metavar="TABLE:COLUMN:PARTS", help="read in parts by a hash of the column")
    ap.add_argument("--jdbc-single", action="append", default=[], metavar="TABLE", help="table read over one connection")
    ap.add_argument("--list-portfolios", action="store_true", help="list the known portfolio codes and exit")
    ap.add_argument("--report", help="one report, or several separated by commas; contact lists then share their contract block")
    ap.add_argument("--portfolios", help="comma-separated portfolio codes, e.g. 517,518")
    ap.add_argument("--out", help="output folder; the report's default name is appended")
    ap.add_argument("--format", choices=["parquet", "csv"], default="csv")
    ap.add_argument("--start", help="period start YYYY-MM-DD (right-party contact report)")
    ap.add_argument("--end", help="period end YYYY-MM-DD (right-party contact report)")
    ap.add_argument("--min-total", help="minimum debt, e.g. 10000 or 'R$ 10.000,00' (largest debts)")
    ap.add_argument("--top", type=int, default=50)
    ap.add_argument("--as-of", help="report clock 'YYYY-MM-DD HH:MM:SS' (default: now)")
    ap.add_argument("--zone", help="time zone of the default clock (default: the session's)")
    ap.add_argument("--phone-slots", type=int, default=PHONE_SLOTS)
    ap.add_argument("--infoad", help="comma-separated portfolio tags (broken report)")
    ap.add_argument("--min-contract-total", help="minimum contract total (broken report)")
    ap.add_argument("--hist-ref-col", default="cod_cli", help="history column with the registration id (right-party contact)")
    ap.add_argument("--money-text", action="store_true", help="write money columns as formatted text")
    ap.add_argument("--widths", action="store_true", help="also write the column widths beside the report")
    ap.add_argument("--agreements-since", default="2025-07-01")
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan instead of running")
    return ap.parse_args(argv)


def build_params(a: argparse.Namespace) -> ReportParams:
    ports = [int(x) for x in (a.portfolios or "").split(",") if x.strip()]
    as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else None
    return ReportParams.from_text(
        ports,
        start=a.start,
        end=a.end,
        min_total=a.min_total,
        as_of=as_of,
        top=a.top,
        agreements_since=dt.date.fromisoformat(a.agreements_since),
        zone=a.zone,
        phone_slots=a.phone_slots,
        infoad=tuple(x.strip() for x in a.infoad.split(",") if x.strip()) if a.infoad else None,
        min_contract_total=parse_money_text(a.min_contract_total) if a.min_contract_total else None,
        hist_ref_col=a.hist_ref_col,
    )


def jdbc_arguments(a: argparse.Namespace, conf) -> dict:
    """Arguments of ``from_jdbc`` from the command line; ``conf`` looks up a Spark setting."""
    properties = dict(x.split("=", 1) for x in a.jdbc_option)
    if "password-conf" in properties:
        properties["password"] = conf(properties.pop("password-conf"))
    partitioning = {}
    for text in a.jdbc_partition:
        table, column, low, high, parts = text.split(":")
        partitioning[table] = (column, int(low), int(high), int(parts))
    for text in a.jdbc_hash:
        table, column, parts = text.split(":")
        partitioning[table] = HashKeys(column, int(parts))
    return {"url": a.tables, "properties": properties, "partitioning": partitioning, "single_connection": tuple(a.jdbc_single)}


def read_tables(spark: SparkSession, a: argparse.Namespace) -> Tables:
    if a.source == "parquet":
        return from_parquet(spark, a.tables, a.hist_day, tuple(x for x in a.may_be_empty.split(",") if x))
    if a.source == "catalog":
        return from_catalog(spark, a.tables, a.hist_day)
    if a.source == "jdbc":
        return from_jdbc(spark, **jdbc_arguments(a, spark.conf.get))
    return from_fixture(spark, a.tables)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parse_args(argv)
    if a.list:
        for key, r in REPORTS.items():
            print(f"{key:24s} {r.label}")
        return 0
    if a.list_portfolios:
        print(*PORTFOLIOS, sep="\n")
        return 0
    if not (a.tables and a.report and (a.out or a.explain)):
        print("--tables, --report and --out (or --explain) are required", file=sys.stderr)
        return 2
    reports = list(dict.fromkeys(x.strip() for x in a.report.split(",") if x.strip()))
    unknown = [x for x in reports if x not in REPORTS]
    if unknown or not reports:
        print(f"error: unknown report {', '.join(unknown)}; one of {', '.join(sorted(REPORTS))}", file=sys.stderr)
        return 2
    if "r11_largest_debts" in reports and not (a.min_total or "").strip():
        print("error: the largest-debts report needs --min-total", file=sys.stderr)
        return 2
    try:
        params = build_params(a)
    except ValueError as exc:
        print(f"error: {exc}", file=sys.stderr)
        return 2
    spark = configure(spark or SparkSession.builder.appName(f"dunning-{'-'.join(reports)}").getOrCreate())
    try:
        tables = read_tables(spark, a)
    except ValueError as exc:
        print(f"error: {exc}", file=sys.stderr)
        return 2
    if a.explain:
        for key in reports:
            REPORTS[key].build(tables, params).explain("formatted")
        return 0
    out = a.out.rstrip("/")
    tables = with_shared_facts(tables, params, reports, f"{out}/_shared")
    for key in reports:
        path = f"{out}/{REPORTS[key].default_name}"
        rows = write_report(REPORTS[key].build(tables, params), path, fmt=a.format, money_text=a.money_text, widths_path=f"{path}_widths" if a.widths else None)
        print(f"{key}: {rows} rows -> {path}")
    return 0
