"""Derive the eight report tables from the driver's TPC-H-like tables.

Each table is a narrow projection of one driver table (plus one or two joins
for instalments and assets), so its size grows with the scale factor. The
rules are fixed (FIXTURES.md §2) and the DuckDB twin in ``oracle_queries.py``
spells the same rules in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.schema import MONEY, SCHEMAS

# The occurrence-code lookup rows (st, bsc). 'error' has no row.
STCOB_ROWS = [
    ("click", "CPC"),
    ("purchase", "CPC PROMESSA"),
    ("view", "sistema"),
    ("signup", None),
    ("unused", ""),
]
# Phone notes by orderkey % 5, asset colours by p_size % 3,
# agreement status by orderkey % 6.
PHONE_NOTES = ["DESCONHECIDO", "Numero incorreto", None, "", "Contato ok"]
COLOURS = ["PRATA", "PRETO", "BRANCO"]
AGREEMENT_CODES = ["P", "G", "A", "Q", "E", "X"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(key: Column, values: list) -> Column:
    """values[key] as a CASE chain (key is a small non-negative int)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    return expr


def _date_plus(base: dt.date, days: Column) -> Column:
    return F.date_add(F.lit(base), days.cast("int"))


def _contract(custkey: Column) -> Column:
    return F.concat(F.lit("CT"), _s(custkey))


def _portfolio(custkey: Column) -> Column:
    return (F.lit(517) + custkey % 4).cast("int")


def derive(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    customer = spark.read.parquet(f"{d}/customer.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    lineitem = spark.read.parquet(f"{d}/lineitem.parquet")
    part = spark.read.parquet(f"{d}/part.parquet")
    events = spark.read.parquet(f"{d}/events.parquet")

    k = F.col("c_custkey")
    cadastros = customer.select(
        k.alias("cod_cad"),
        F.col("c_name").alias("nomecli"),
        F.lpad(_s(k * 7919 + 10000000), 11, "0").alias("cpfcnpj"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lower("c_name"), F.lit("@example.com")))
        .alias("email"),
        _contract(F.when(k % 20 == 19, k - 4).otherwise(k)).alias("nmcont"),
        _portfolio(k).alias("cod_cli"),
        F.when(k % 11 == 0, F.lit("INA")).when(k % 37 == 1, F.lit(None)).otherwise(F.lit("ATI")).alias("stcli"),
        F.col("c_mktsegment").alias("infoad"),
        F.when(k % 23 == 2, F.lit(None).cast("date"))
        .otherwise(_date_plus(dt.date(1950, 1, 1), k * 37 % 18000))
        .alias("nascto"),
        F.date_sub(F.lit(dt.date(2025, 10, 1)), (k % 120).cast("int")).alias("data_cad"),
        F.date_sub(
            F.lit(dt.date(2025, 10, 1)),
            (k % 120 + F.when(k % 3 == 0, 1).otherwise(0)).cast("int"),
        ).alias("data_arq"),
    )

    o = F.col("o_orderkey")
    fones = orders.select(
        F.col("o_custkey").alias("cod_cad"),
        _s(11 + o % 80).alias("dddfone"),
        F.when(o % 29 == 0, F.concat(F.lit("99999999"), _s(o % 10)))
        .when(o % 31 == 0, F.concat(F.lit("9X"), _s(o)))
        .when(o % 41 == 0, F.lit("123"))
        .when(o % 43 == 0, F.lit(None).cast("string"))
        .otherwise(_s(F.lit(900000000) + o * 7919 % 99999999))
        .alias("telefone"),
        F.when(o % 19 == 0, F.lit(None).cast("int")).otherwise((o % 9).cast("int")).alias("status"),
        _pick(o % 5, PHONE_NOTES).alias("obs"),
    )

    acordos = orders.select(
        o.alias("cod_aco"),
        _contract(F.col("o_custkey")).alias("nmcont"),
        F.when(o % 13 == 0, F.lit(517)).otherwise(_portfolio(F.col("o_custkey"))).cast("int").alias("cod_cli"),
        _date_plus(dt.date(2025, 6, 1), o % 120).alias("data_cad"),
        _date_plus(dt.date(2025, 6, 3), o % 120).alias("data_aco"),
        F.col("o_totalprice").cast(MONEY).alias("vlr_aco"),
        F.when(o % 17 == 0, F.lit(None).cast("int")).otherwise((o % 5).cast("int")).alias("qtd_p_aco"),
        _pick(o % 6, AGREEMENT_CODES).alias("staco"),
    )

    lo = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lk = F.col("l_orderkey")
    prefix = F.when(lk % 7 == 0, F.lit("ENTRADA ")).when(lk % 47 == 5, F.lit(None).cast("string")).otherwise(F.lit(""))
    receber = lo.select(
        _contract(F.col("o_custkey")).alias("nmcont"),
        _portfolio(F.col("o_custkey")).alias("cod_cli"),
        F.concat(prefix, _s(lk), F.lit("/"), _s(F.col("l_linenumber"))).alias("fat_parc"),
        F.col("l_extendedprice").cast(MONEY).alias("vlrparc"),
    )

    # One complement row per customer, a second ('CDC') for even keys:
    # a generator, not a join.
    n = F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rec_comp = customer.select("c_custkey", "c_mktsegment", n.alias("n")).select(
        _contract(k).alias("nmcont"),
        _portfolio(k).alias("cod_cli"),
        F.when(k % 17 == 3, F.lit(None).cast("int")).otherwise((k * 13 % 100000 + F.col("n")).cast("int")).alias("int_2"),
        F.when(F.col("n") == 0, F.col("c_mktsegment")).otherwise(F.lit("CDC")).alias("char_5"),
    )

    lop = lo.join(part, F.col("l_partkey") == F.col("p_partkey"))
    pk, ps = F.col("p_partkey"), F.col("p_size")
    bens = lop.select(
        _contract(F.col("o_custkey")).alias("nmcont"),
        _portfolio(F.col("o_custkey")).alias("cod_cli"),
        F.col("p_brand").alias("marca"),
        F.when(F.col("l_partkey") % 53 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("modelo"),
        F.concat(F.lit("PLC"), F.lpad(_s(pk), 5, "0")).alias("placa"),
        _pick(ps % 3, COLOURS).alias("cor"),
        (F.lit(2000) + ps % 20).cast("int").alias("anofab"),
        (F.lit(2001) + ps % 20).cast("int").alias("anomodelo"),
        F.when(F.col("l_partkey") % 59 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("CH"), _s(pk)))
        .alias("chassi"),
    )

    e = F.col("event_id")
    hist = events.select(
        e.alias("cod_hist"),
        (F.col("user_id") * 10 + e % 10).alias("cod_cli"),
        (F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL '584' DAY")).alias("data_at"),
        F.col("event_type").alias("ocorr"),
        F.when(e % 25 == 7, F.lit(None).cast("string"))
        .when(e % 5 == 0, F.lit("999"))
        .otherwise(_s(e % 50))
        .alias("cod_usu"),
    )

    stcob = spark.createDataFrame(STCOB_ROWS, SCHEMAS["stcob_tb"])

    raw = {
        "cadastros_tb": cadastros,
        "fones_tb": fones,
        "acordos_tb": acordos,
        "receber_tb": receber,
        "rec_comp_tb": rec_comp,
        "bens_tb": bens,
        "hist_tb": hist,
        "stcob_tb": stcob,
    }
    out = {}
    for name, df in raw.items():
        schema = SCHEMAS[name]
        out[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out
