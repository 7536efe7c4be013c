from __future__ import annotations

import os
import tempfile
from decimal import Decimal

from dunning.sinks.files import display_widths, money_formatted, write_report


def test_write_report_counts_rows_during_the_write(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    out = os.path.join(tempfile.mkdtemp(prefix="dunning-sink-"), "r")
    assert write_report(df, out, fmt="csv") == 3
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == 3 and back.columns == ["k", "v"]


def test_display_widths(spark):
    df = spark.createDataFrame([("x" * 3, 1), ("y" * 70, None)], "nome string, valor_total int")
    got = [(r.posicao, r.coluna, r.largura) for r in display_widths(df).collect()]
    assert got == [(1, "nome", 60), (2, "valor_total", 13)]
    got = [(r.coluna, r.largura) for r in display_widths(df.limit(0)).collect()]
    assert got == [("nome", 10), ("valor_total", 13)]


def test_money_formatted_only_numeric_money_columns(spark):
    df = spark.createDataFrame(
        [(Decimal("1234567.5"), "acordo", 3)], "ValorTotalDivida decimal(18,2), TipoAcordo string, qtd int"
    )
    (row,) = money_formatted(df).collect()
    assert (row.ValorTotalDivida, row.TipoAcordo, row.qtd) == ("1,234,567.50", "acordo", 3)


def test_write_report_money_text_and_widths(spark):
    df = spark.createDataFrame([(Decimal("1234567.5"), "a"), (None, "b" * 90)], "valor decimal(18,2), nome string")
    out = tempfile.mkdtemp(prefix="dunning-sink-money-")
    for fmt in ("parquet", "csv"):
        assert write_report(df, f"{out}/{fmt}", fmt=fmt, money_text=True, widths_path=f"{out}/{fmt}_widths") == 2
        back = spark.read.format(fmt).option("header", "true").load(f"{out}/{fmt}")
        assert {r.valor for r in back.collect()} == {"1,234,567.50", None}
        widths = spark.read.option("header", "true").csv(f"{out}/{fmt}_widths").orderBy("posicao").collect()
        assert [(r.coluna, int(r.largura)) for r in widths] == [("valor", 14), ("nome", 60)]
