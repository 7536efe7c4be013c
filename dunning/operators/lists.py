"""Ordered text lists (``GROUP_CONCAT(DISTINCT x ORDER BY ...)``), one per key, of any length.

Nulls are skipped and nothing is truncated. The callers remove repeats in a hash aggregate on
(key, value) first, which also spreads a hot key's values over tasks.

The values of a key are dealt by ranges of the order into pieces of ``BUCKET`` values: Spark's sort, which
spills, puts them in order, and each piece is joined to text by itself. So no array is longer than a piece, however
many values a key has; only finished text meets, piece by piece, in the key's cell. The cell itself
(2 GB at most, as any value in Spark) bounds what one key can bring to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.fixed import LIST_SEPARATOR

#: Most values of a key that are sorted in one array.
BUCKET = 10_000
_PIECE, _TEXT = "__piece", "__text"


def _joined(order: Sequence[str], text: str, sep: str) -> Column:
    """The texts of a group in order, as one; null if there are none."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias(_TEXT)))), lambda z: z[_TEXT]), sep)
    return F.when(F.count(text) > 0, joined)


def in_pieces(items: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: int) -> DataFrame:
    """``items`` with the piece of their key's order that each is in, at most ``bucket`` to a piece."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn(_PIECE, F.floor((nth - 1) / bucket))


def ordered_lists(
    items: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    out: str,
    sep: str = LIST_SEPARATOR,
    bucket: int | None = None,
    also: Mapping[str, tuple[Callable[[str], Column], str]] | None = None,
) -> DataFrame:
    """``keys`` and ``out``: the texts of each key in order, joined by ``sep``; null for a key without any.

    ``items`` has distinct texts per key, of which null is one; ``order`` may repeat ``text``. ``also`` names
    further results of the same pass: an aggregate that may be taken of parts (``F.sum``, ``F.max``) and its column.
    """
    pieces, also = in_pieces(items, keys, order, bucket or BUCKET), also or {}
    texts = pieces.groupBy(*keys, _PIECE).agg(_joined(order, text, sep).alias(out), *[f(c).alias(name) for name, (f, c) in also.items()])
    return texts.groupBy(*keys).agg(_joined([_PIECE], out, sep).alias(out), *[f(name).alias(name) for name, (f, _) in also.items()])
