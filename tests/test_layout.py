"""Stored layout: same report results as the derived tables, and the
history windows prune day partitions."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dunning.params import FIXTURE_PARAMS
from dunning.plans.reports import REPORTS
from dunning.sources.layout import HIST_PARTITION, PORTFOLIO_PARTITIONED, write_bucketed, write_tables
from dunning.sources.tables import HashKeys, from_catalog, from_fixture, from_parquet, jdbc_options
from dunning.schema import SCHEMAS
from tests.conftest import SMALL, SMOKE
from tests.test_skew import shuffle_records


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="dunning-layout-")
    write_tables(from_fixture(spark, SMOKE), root, files=2)
    return from_parquet(spark, root, hist_day=HIST_PARTITION)


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_stored_tables_give_the_same_reports(spark, stored, key):
    derived = REPORTS[key].build(from_fixture(spark, SMOKE), FIXTURE_PARAMS)
    again = REPORTS[key].build(stored, FIXTURE_PARAMS)
    assert again.columns == derived.columns
    assert again.exceptAll(derived).count() == 0 and derived.exceptAll(again).count() == 0


@pytest.mark.parametrize("key", ["r05_cpc_period", "r06_no_history_30d", "r08_never_contacted"])
def test_history_windows_prune_day_partitions(stored, key):
    text = REPORTS[key].build(stored, FIXTURE_PARAMS)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "hist_tb" in line]
    assert scans and all("PartitionFilters: [isnotnull(event_day" in s and "(event_day#" in s for s in scans)


def test_a_busy_day_is_written_by_several_tasks(spark, make_tables):
    import datetime as dt
    import glob

    day = dt.datetime(2025, 9, 10, 8, 0, 0)
    rows = [(k, k % 50, day + dt.timedelta(seconds=k), "click", "5") for k in range(2000)]
    t = make_tables(hist=rows)
    root = tempfile.mkdtemp(prefix="dunning-layout-day-")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")  # a "busy" day is now many times the advisory size
    try:
        write_tables(t, root)
    finally:
        spark.conf.set(key, before)
    files = glob.glob(f"{root}/hist_tb/event_day=2025-09-10/*.parquet")
    assert len(files) >= 2
    assert from_parquet(spark, root, HIST_PARTITION, PORTFOLIO_PARTITIONED).hist.count() == 2000


def test_a_day_column_of_another_meaning_is_not_used(spark, make_tables):
    """A column that happens to be called dt (a load day) filters nothing."""
    import datetime as dt

    cad = (1, "N", "1", None, "CT1", 517, "ATI", None, None, None, None)
    at = dt.datetime(2025, 8, 20, 23, 50)
    t = make_tables(cadastros=[cad], hist=[(1, 1, at, "click", "5")], stcob=[("click", "CPC")])
    root = tempfile.mkdtemp(prefix="dunning-layout-load-")
    for name, df in t.by_name().items():
        df = df.withColumn("dt", F.lit(dt.date(2025, 8, 21))).drop("cod_hist") if name == "hist_tb" else df
        df.write.parquet(f"{root}/{name}")
    read = from_parquet(spark, root)
    assert "dt" in read.hist.columns and "cod_hist" not in read.hist.columns
    assert REPORTS["r05_cpc_period"].build(read, FIXTURE_PARAMS).count() == 1
    with pytest.raises(ValueError):
        from_parquet(spark, root, hist_day="no_such_day")


def test_an_emptied_folder_is_an_error(spark, make_tables):
    root = tempfile.mkdtemp(prefix="dunning-layout-empty-")
    t = make_tables()
    for name, df in t.by_name().items():
        (df.write.partitionBy("ocorr") if name == "hist_tb" else df.write).parquet(f"{root}/{name}")
    with pytest.raises(AnalysisException):
        from_parquet(spark, root)
    assert from_parquet(spark, root, may_be_empty=("hist_tb",)).hist.count() == 0


def test_jdbc_options_need_a_decision_per_table():

    parts = {"hist_tb": ("cod_cli", 0, 1000, 16)}
    with pytest.raises(ValueError, match="acordos_tb"):
        jdbc_options("jdbc:x", {}, parts)
    rest = tuple(n for n in SCHEMAS if n != "hist_tb")
    made = jdbc_options("jdbc:x", {"user": "u"}, parts, rest)
    assert made["hist_tb"] == {"url": "jdbc:x", "dbtable": "hist_tb", "user": "u", "partitionColumn": "cod_cli", "lowerBound": "0", "upperBound": "1000", "numPartitions": "16"}
    assert made["stcob_tb"] == {"url": "jdbc:x", "dbtable": "stcob_tb", "user": "u"}


def test_catalog_source_reads_registered_tables(spark):
    from dunning.sources.tables import from_catalog

    derived = from_fixture(spark, SMOKE)
    for name, df in derived.by_name().items():
        df.createOrReplaceTempView(name)
    t = from_catalog(spark)
    for name, df in t.by_name().items():
        assert df.schema == derived.by_name()[name].schema
    got = REPORTS["r05_cpc_period"].build(t, FIXTURE_PARAMS)
    want = REPORTS["r05_cpc_period"].build(derived, FIXTURE_PARAMS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_filters_reach_the_parquet_reader(stored):
    text = REPORTS["r06_no_history_30d"].build(stored, FIXTURE_PARAMS)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    cad = [s for s in scans if "cadastros_tb" in s]
    hist = [s for s in scans if "hist_tb" in s and "cod_cli" in s.split("]")[0]]
    # cod_cli is the partition column of the stored registrations: a partition filter
    assert cad and all("cod_cli" in s.split("PartitionFilters: [")[1].split("]")[0] for s in cad)
    assert hist and all("GreaterThanOrEqual(data_at," in s for s in hist)
    # only the columns the report needs are read
    assert all("email" not in s.split("ReadSchema:")[1] for s in cad)


def test_portfolio_filter_prunes_partitions(stored):
    text = REPORTS["r11_largest_debts"].build(stored, FIXTURE_PARAMS)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    for table in ("cadastros_tb", "receber_tb"):
        lines = [s for s in scans if table in s]
        assert lines and all("PartitionFilters: [" in s and "cod_cli" in s.split("PartitionFilters: [")[1] for s in lines)


def test_hash_predicates_part_every_row_once(spark):
    """Held against Spark's own CRC32 and MOD, as no database may run: disjoint, complete, nulls included."""
    rows = spark.range(3000).select(F.when(F.col("id") % 11 > 0, F.concat(F.lit("CT"), F.col("id").cast("string"))).alias("nmcont"))
    for parts in (1, 2, 7, 64):
        for hash_sql in ("CRC32({column})", "CAST(CRC32({column}) AS BIGINT) - 2000000000"):  # the second gives negative numbers too
            conditions = HashKeys("nmcont", parts, hash_sql).predicates()
            assert len(conditions) == len(set(conditions)) == parts
            met = rows.select(sum((F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END") for c in conditions), F.lit(0)).alias("n"))
            assert [r.n for r in met.distinct().collect()] == [1]
    sizes = [rows.where(c).count() for c in HashKeys("nmcont", 8).predicates()]
    assert min(sizes) > 200


def test_hash_keys_are_a_decision_and_no_range_option():
    options = jdbc_options("jdbc:db://h/d", {"user": "u"}, {"receber_tb": HashKeys("nmcont", 4)}, [n for n in SCHEMAS if n != "receber_tb"])
    assert options["receber_tb"] == {"url": "jdbc:db://h/d", "dbtable": "receber_tb", "user": "u"}


def test_bucketed_tables_need_no_exchange_of_the_large_side(spark, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}'")
    try:
        write_bucketed(from_fixture(spark, SMALL), "bucketed", 4)
        t = from_catalog(spark, "bucketed", hist_day=HIST_PARTITION)
        contracts = t.receber.select("nmcont", "cod_cli").distinct().count()
        for key, most in (("r03_phones_top7", t.cadastros.count()), ("r11_largest_debts", max(contracts, t.cadastros.count()))):
            df = REPORTS[key].build(t, FIXTURE_PARAMS)
            written = shuffle_records(df)
            assert max(written, default=0) <= most, (key, written)
            want = REPORTS[key].build(from_fixture(spark, SMALL), FIXTURE_PARAMS)
            assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
        assert t.fones.count() > 2 * t.cadastros.count() and t.receber.count() > 2 * contracts
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")
