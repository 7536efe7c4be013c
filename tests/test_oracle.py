"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE

RAW = "region nation customer supplier part orders lineitem events".split()


# the training-data queries have tests of their own, in tests/llm
REFERENCE = [k for k in E.queries() if not k.startswith("op") and k != "pipeline"]


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{v:.6f}"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(REFERENCE) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(REFERENCE))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SMOKE)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sdf.columns
    s_rows = sorted(tuple(_norm(v) for v in r) for r in sdf.collect())
    idx = [rel.columns.index(c) for c in cols]
    o_rows = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s_rows == o_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:6] == ["cod_cad", "nome", "cpf", "nmcont", "cod_cli", "portfolio"]
    assert df.count() > 0
