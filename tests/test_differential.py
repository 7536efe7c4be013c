"""Differential test: random messy micro-tables, every report in Spark and in
the oracle SQL (the reference's SQL shape, in DuckDB) over the same rows."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest

import oracle_queries as OQ
from dunning.params import FIXTURE_PARAMS
from dunning.plans.reports import REPORTS
from dunning.schema import SCHEMAS
from tests.test_oracle import _norm

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(18,2)": "DECIMAL(18,2)",
}
AS_OF = dt.datetime(2025, 10, 1, 12, 0, 0)


def _maybe(r: random.Random, v, p=0.15):
    return None if r.random() < p else v


def make_rows(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    n = 25
    pool = [f"CT{i}" for i in range(18)]
    contract = lambda: _maybe(r, r.choice(pool), 0.05)
    port = lambda: r.choice([517, 518, 519])
    cad = []
    for k in range(1, n + 1):
        d = dt.date(2025, 10, 1) - dt.timedelta(days=r.randrange(0, 100))
        cad.append((k, f"N{k}", f"{k:011d}", _maybe(r, f"n{k}@x"), contract(), port(),
                    r.choice(["ATI", "ATI", "INA", None]), r.choice(["AUTO", "BUILD", None]),
                    _maybe(r, dt.date(1970, 1, 1) + dt.timedelta(days=r.randrange(9000))),
                    d, r.choice([d, d, d - dt.timedelta(days=1)])))
    cad.append((None, "NULL", "00000000000", None, "CT1", 517, "ATI", "AUTO", None, dt.date(2025, 9, 1), dt.date(2025, 9, 1)))

    cad += [r.choice(cad)] * r.randrange(3)  # a repeated registration row

    def phone_text():
        kind = r.random()
        if kind < 0.1:
            return "9" + str(r.randrange(10)) * 6 + "1"
        if kind < 0.18:
            return "9X" + str(r.randrange(10**6))
        if kind < 0.25:
            return str(r.randrange(100))
        if kind < 0.3:
            return None
        return "9" + "".join(r.choice("0123456789") for _ in range(8))

    fones = []
    for _ in range(n * 5):
        row = (r.randrange(1, n + 3), _maybe(r, r.choice(["11", "21", "31"]), 0.05), phone_text(),
               _maybe(r, r.randrange(0, 9)),
               r.choice(["DESCONHECIDO", "Numero incorreto", None, "", "Contato ok", "desconhecido", "ok"]))
        fones.append(row)
        if r.random() < 0.15:
            fones.append(row)  # exact duplicate

    acordos = []
    for k in range(1, n * 3):
        d = dt.date(2025, 6, 15) + dt.timedelta(days=r.randrange(0, 90))
        acordos.append((k * 7 % 1000 + k * 1000, _maybe(r, r.choice(pool), 0.03), port(), d, d,
                        Decimal(r.randrange(100, 10**7)) / 100, r.choice([None, 0, 1, 2, 6]),
                        r.choice(["P", "G", "A", "Q", "E", "X", None])))

    receber = []
    for _ in range(n * 6):
        fat = r.choice(["ENTRADA ", "", "entrada ", None, ""])
        receber.append((contract(), port(), None if fat is None else f"{fat}{r.randrange(50)}/{r.randrange(4)}",
                        Decimal(r.randrange(10**5, 10**8)) / 100))
    rec_comp = [(contract(), port(), _maybe(r, r.randrange(10**5)), _maybe(r, r.choice(["CDC", "LEASING", "AUTO"])))
                for _ in range(n * 2)]
    bens = [(contract(), port(), _maybe(r, r.choice(["VW", "FIAT", "GM"])), _maybe(r, r.choice(["GOL", "UNO", "ONIX"])),
             _maybe(r, f"P{r.randrange(30)}"), r.choice(["PRATA", "PRETO"]), r.randrange(2000, 2020),
             r.randrange(2000, 2021), _maybe(r, f"C{r.randrange(25)}")) for _ in range(n * 2)]
    hist = []
    for k in range(n * 6):
        at = AS_OF - dt.timedelta(days=r.randrange(0, 50), seconds=r.randrange(86400))
        if r.random() < 0.1:
            at = dt.datetime(2025, 8, r.choice([14, 15, 20, 21]), 23, 59, 59, r.choice([0, 500000]))
        hist.append((k, _maybe(r, r.randrange(1, n + 3), 0.02), at,
                     r.choice(["click", "purchase", "view", "signup", "error"]), r.choice(["999", None, "5", "7", "8"])))
    stcob = [("click", "CPC"), ("purchase", "CPC PROMESSA"), ("view", "sistema"), ("signup", None), ("unused", "")]
    if r.random() < 0.5:
        stcob.append(("click", "cpc"))
    return dict(cadastros=cad, fones=fones, acordos=acordos, receber=receber, rec_comp=rec_comp, bens=bens,
                hist=hist, stcob=stcob)


def _duck(rows: dict[str, list[tuple]]):
    con = duckdb.connect()
    for name, schema in SCHEMAS.items():
        cols = ", ".join(f"{f.name} {DUCK_TYPES[f.dataType.simpleString()]}" for f in schema.fields)
        con.execute(f"CREATE TABLE {name} ({cols})")
        data = rows[name[: -len("_tb")]]
        if data:
            marks = ", ".join("?" for _ in schema.fields)
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", data)
    return con


def _oracle_body(sql: str) -> str:
    body = sql[len(OQ.FIXTURE_CTE):]
    return "WITH __none AS (SELECT 1)" + body if body.lstrip().startswith(",") else body


@pytest.mark.parametrize("seed", range(6))
def test_reports_match_oracle_on_random_tables(spark, make_tables, seed):
    rows = make_rows(seed)
    t = make_tables(**rows)
    con = _duck(rows)
    for key, report in REPORTS.items():
        sdf = report.build(t, FIXTURE_PARAMS)
        rel = con.sql(_oracle_body(OQ.REPORTS[key]))
        assert sorted(sdf.columns) == sorted(rel.columns), key
        idx = [rel.columns.index(c) for c in sdf.columns]
        s_rows = sorted(tuple(_norm(v) for v in x) for x in sdf.collect())
        o_rows = sorted(tuple(_norm(x[i]) for i in idx) for x in rel.fetchall())
        assert s_rows == o_rows, f"seed {seed} {key}: spark {len(s_rows)} rows, oracle {len(o_rows)} rows"


@pytest.mark.parametrize("seed", range(3))
def test_blocks_and_variants_match_oracle_on_random_tables(spark, make_tables, seed):
    from dunning.plans.catalog import EXTRA

    rows = make_rows(100 + seed)
    t = make_tables(**rows)
    con = _duck(rows)
    for key, fn in EXTRA.items():
        sdf = fn(t, FIXTURE_PARAMS)
        rel = con.sql(_oracle_body(OQ.EXTRA[key]))
        assert sorted(sdf.columns) == sorted(rel.columns), key
        idx = [rel.columns.index(c) for c in sdf.columns]
        s_rows = sorted(tuple(_norm(v) for v in x) for x in sdf.collect())
        o_rows = sorted(tuple(_norm(x[i]) for i in idx) for x in rel.fetchall())
        assert s_rows == o_rows, f"seed {seed} {key}: spark {len(s_rows)} rows, oracle {len(o_rows)} rows"
