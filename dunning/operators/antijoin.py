"""``key NOT IN (subquery)`` with SQL null semantics, without a broadcast.

Spark plans an uncorrelated NOT IN as a null-aware anti join only when the
subquery side can be broadcast; beyond that it falls back to a nested-loop
join. Here the list is reduced once to its distinct keys, null included, and
read two ways: a plain shuffle anti join, and a scalar that says whether the
list is empty or holds a null:

* empty list            -> every left row is kept (even a null key)
* list holds a null     -> no row is kept (NOT IN is never true)
* otherwise             -> keep rows whose key is not null and not in the list

The key is grouped inside a struct, which itself is never null. So no filter on it
is pushed into one reader only, both readers have the same exchange, and the
list is scanned and shuffled once (the other reader reuses it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_K, _V = "__not_in_key", "v"


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` where ``left[key] NOT IN (SELECT right_key FROM right)``."""
    boxed = right.select(F.struct(F.col(right_key or key).alias(_V)).alias(_K))
    listed = boxed.groupBy(_K).agg(F.count(F.lit(1)).alias("__n"))  # one row per key and task before the shuffle
    state = listed.agg(F.struct(F.coalesce(F.max(F.col(_K)[_V].isNull()), F.lit(False)).alias("null"), (F.count(F.lit(1)) == 0).alias("empty")).alias("s"))
    flags = state.scalar()
    kept = left.join(listed, F.struct(left[key].alias(_V)) == listed[_K], "left_anti")
    return kept.where(~flags["null"] & (F.col(key).isNotNull() | flags["empty"]))


def anti_join(left: DataFrame, key: str, right: DataFrame, right_key: str | None = None) -> DataFrame:
    """Correlated ``NOT IN`` / ``NOT EXISTS``: no null trap, a plain anti join
    against the distinct right keys."""
    right_key = right_key or key
    present = right.select(F.col(right_key).alias(_K)).where(F.col(_K).isNotNull()).distinct()
    return left.join(present, left[key] == present[_K], "left_anti")
