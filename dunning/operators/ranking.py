"""Latest row per key, top-N per key, and slot pivots.

``row_number`` followed by a ``<= n`` filter plans as a WindowGroupLimit: a
partial limit runs before the shuffle, so a key that holds a third of all rows
sends at most ``n`` rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank_col: str = "_rn") -> DataFrame:
    """Keep the first row of each key group under ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) == 1).drop(rank_col)


def top_n_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int, rank_col: str = "num") -> DataFrame:
    """Number rows within ``key`` by ``order`` and keep numbers ``<= n``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def slot(rank_col: str, k: int, value: Column) -> Column:
    """``MAX(CASE WHEN rank = k THEN value END)``."""
    return F.max(F.when(F.col(rank_col) == k, value))


def pivot_slots(
    df: DataFrame,
    keys: Sequence[str],
    rank_col: str,
    value: str,
    n: int,
    name: str,
    extra: dict[str, tuple[int, str]] | None = None,
) -> DataFrame:
    """One row per key with columns ``{name}1 .. {name}n`` taken from rank 1..n.

    ``extra`` adds more slot columns: output name -> (rank, source column).
    """
    aggs = []
    extra = extra or {}
    for k in range(1, n + 1):
        aggs.append(slot(rank_col, k, F.col(value)).alias(f"{name}{k}"))
        for out, (rank, src) in extra.items():
            if rank == k:
                aggs.append(slot(rank_col, k, F.col(src)).alias(out))
    return df.groupBy(*keys).agg(*aggs)
