"""Key-set pushdown: rows whose key cannot be among the wanted ones leave at their scan.

A semi join drops them too, but only after the large side has been shuffled by the key.
Here the wanted keys become a bit array of fixed size (one hash a key), read once as a scalar, and
a row stays when the bit of its key is set. No wanted row is lost; of the others a few stay, and
leave at the join that follows. The array's size is a parameter and does not grow with the keys:
beyond a million keys it keeps ever more rows, at last all, and the join alone does the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the array (128 kB): one row in ten of the others stays at 110,000 keys.
FILTER_BITS = 1 << 20
_W, _B = "__word", "__bits"


def may_be_among(keys: DataFrame, columns: Sequence[str], bits: int | None = None) -> Column:
    """Condition on the same ``columns`` of another table that holds for all rows whose key ``keys`` has."""
    bits = bits or FILTER_BITS
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    word = F.floor(place / 64).cast("int")
    set_bits = keys.select(word.alias(_W), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias(_B))
    blank = keys.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").cast("int").alias(_W), F.lit(0).cast("long").alias(_B))
    words = set_bits.unionByName(blank).groupBy(_W).agg(F.bit_or(_B).alias(_B))  # at most one row a word and task
    array = words.agg(F.transform(F.sort_array(F.collect_list(F.struct(_W, _B))), lambda z: z[_B]).alias("a"))
    return F.getbit(F.get(array.scalar(), word), F.pmod(place, F.lit(64)).cast("int")) == 1
