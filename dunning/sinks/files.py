"""Write a report to files, and the two spreadsheet rules kept as Spark jobs.

The reference saved one spreadsheet per report from client memory. Here a
report is written by the executors to ``<out>/<report>/`` (Parquet or CSV with
a header), never coalesced to one task. Its column-width rule and money
format rule are DataFrame operations over the whole result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.fixed import MAX_WIDTH, MIN_WIDTH, MONEY_DECIMALS, MONEY_KEYWORDS, WIDTH_PAD


def display_widths(df: DataFrame) -> DataFrame:
    """Per column: ``max(10, min(longest + 2, 60))`` where ``longest`` is the
    longest text of the header or of any non-null value.

    One aggregation pass over the whole result computes every column's longest
    value; the result has one row per column (position, name, width).
    """
    aggs = [F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"l{i}") for i, c in enumerate(df.columns)]
    longest = df.agg(*aggs)
    rows = []
    for i, c in enumerate(df.columns):
        top = F.greatest(F.lit(len(c)), F.coalesce(F.col(f"l{i}"), F.lit(0)))
        width = F.greatest(F.lit(MIN_WIDTH), F.least(top + WIDTH_PAD, F.lit(MAX_WIDTH)))
        rows.append(F.struct(F.lit(i + 1).alias("posicao"), F.lit(c).alias("coluna"), width.alias("largura")))
    return longest.select(F.inline(F.array(*rows)))


def is_money_column(name: str, dtype: T.DataType) -> bool:
    numeric = isinstance(dtype, T.NumericType)
    return numeric and any(k in name.lower() for k in MONEY_KEYWORDS)


def money_formatted(df: DataFrame) -> DataFrame:
    """Money columns (numeric, name with a money keyword) as ``#,##0.00`` text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.format_number(c, MONEY_DECIMALS).alias(f.name) if is_money_column(f.name, f.dataType) else c)
    return df.select(*cols)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", money_text: bool = False, widths_path: str | None = None) -> int:
    """Write a report and return its row count, observed during the write
    (no second pass over the data).

    ``money_text`` writes money columns as formatted text. ``widths_path`` also writes the
    column widths of what was written, measured over the written files where
    they can be read back with their types (not for csv: there over the report itself).
    """
    shown = money_formatted(df) if money_text else df
    obs = Observation("report")
    observed = shown.observe(obs, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)
    rows = int(obs.get["rows"])
    if widths_path is not None:
        written = shown if fmt == "csv" else df.sparkSession.read.format(fmt).load(path)
        display_widths(written).coalesce(1).write.mode(mode).option("header", "true").csv(widths_path)  # one row per column
    return rows
