"""Document fingerprints: threshold-scaled sketches of word shingles, in Spark functions only.

A sketch keeps every distinct shingle hash that lies in the lowest ``FRACTION`` of all
64-bit numbers. So the sketch of a union is the union of sketches, and the share of
one sketch found in another estimates containment, however unequal the documents
are. A text none of whose shingles falls below the threshold (it has few) is kept whole
instead; two such texts compare exactly, but of one and another kind of sketch nothing follows, and their likeness is
null. Where the texts are at hand, as in ``edits``, they are then compared by all their hashes.

The fingerprint is the sorted sketch in hexadecimal, 16 digits a hash. Likeness is the
share of the smaller sketch (or text) that the other holds.

Nulls and edges: a null text is an empty one; a text without words has an empty
fingerprint, like 1 to another such text and 0 to any other; fewer words than a
shingle has are one shingle; very long texts are sketched whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.llm.common import FIRST, let, narrow

SHINGLE_WORDS = 5
#: One hash in so many is kept.
SCALE = 4
#: Documents of one stretch of ids, and stretches at most (then they grow).
STRETCH_ROWS, STRETCHES = 1024, 4096


def hashes(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles: XXH64 over the words' XXH64s."""
    words = F.transform(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle_words - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(shingle_words))))).otherwise(F.array().cast("array<bigint>"))

    return let(words, shingles)


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted kept hashes (array of long) of a text; null counts as empty."""
    return let(hashes(F.coalesce(text, F.lit("")), shingle_words), lambda found: _kept(found, scale))


def _kept(found: Column, scale: int = SCALE) -> Column:
    """The hashes below the threshold, or all where there is none."""
    low = F.array_distinct(F.filter(found, lambda h: h < F.lit(FIRST + (1 << 64) // scale)))
    return F.sort_array(F.when(F.size(low) > 0, low).otherwise(F.array_distinct(found)))


def whole(kept: Column, scale: int = SCALE) -> Column:
    """Whether the sketch holds all hashes of its text, as none is below the threshold; so does an empty one."""
    return (F.size(kept) == 0) | (F.get(kept, F.lit(0)) >= F.lit(FIRST + (1 << 64) // scale))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of all texts together."""
    return let(F.flatten(F.collect_set(sketches)), lambda found: _kept(found))


def contained(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds; null where the sketches cannot tell."""
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(both_empty, 1.0).when(F.size(a) == 0, 0.0).when((F.size(b) == 0) | (whole(a) == whole(b)), share)


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller in the larger, 0 to 1; null where one sketch is whole and the other is not."""
    either, both = (F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == 0) & (F.size(b) == 0)
    share = F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))
    return F.when(both, 1.0).when(either, 0.0).when(whole(a) == whole(b), share)


def text_likeness(a: Column, b: Column, kept_a: Column, kept_b: Column) -> Column:
    """Likeness by the sketches or, where these cannot tell, by all hashes of both texts (one of which is short)."""
    sets = [F.array_distinct(hashes(F.coalesce(t, F.lit("")))) for t in (a, b)]
    exact = let(F.struct(sets[0].alias("a"), sets[1].alias("b")), lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.least(F.size(s["a"]), F.size(s["b"])))
    return F.coalesce(likeness(kept_a, kept_b), exact)


def as_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _bounds(df: DataFrame, place: Column, tie: str) -> list[tuple[int, int]]:
    """Where stretches begin, as (place, tie): approximate quantiles of the places, and within a place
    that holds more than a stretch also even steps of the tie, which is a hash."""
    n = df.count()
    parts = max(1, min(STRETCHES, math.ceil(n / STRETCH_ROWS)))
    cuts = df.select(F.percentile_approx(place, [i / parts for i in range(parts)], 10 * STRETCHES).alias("cuts")).first().cuts or []
    bounds = {(FIRST, FIRST), *((c, FIRST) for c in cuts)}
    crowded = [c for c, times in Counter(cuts).items() if times > 1]
    for r in df.where(place.isin(crowded)).groupBy(place.alias("at")).count().collect() if crowded else ():  # a row per crowded place
        steps = min(STRETCHES, math.ceil(r["count"] / STRETCH_ROWS))
        bounds |= {(r["at"], FIRST + i * (1 << 64) // steps) for i in range(steps)}
    return sorted(bounds)


def with_next(df: DataFrame, key: str, carry: list[str], tie: str, add: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``df`` and, as ``next_<name>``, the carried columns of the row with the next larger ``key`` (after the last: the first).

    Rows are dealt into stretches of neighbouring (key, tie) pairs; the first row of a stretch is
    also listed at the end of the stretch before. So each stretch finds its followers alone, and
    no task sees the whole order, however many rows share a key. Equal keys follow each other in the order of ``tie``, a
    hash; a null key comes first. Only rows equal in both stay together, and are sorted on disk if need be.
    ``add`` gives rows further columns once they are dealt.
    """
    place = F.coalesce(F.col(key), F.lit(FIRST))
    bounds = _bounds(df, place, tie)
    step = math.isqrt(len(bounds) - 1) + 1
    here = F.struct(F.col("x_place"), F.col(tie).alias("x_tie"))

    def listed(some: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(b).alias("x_place"), F.lit(t).alias("x_tie")) for b, t in some])

    # found in two steps, each over the root of the number of bounds
    row = F.size(F.filter(listed(bounds[::step]), lambda b: b <= here))
    fine = F.array(*[listed(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    col = F.size(F.filter(F.element_at(fine, F.col("x_row")), lambda b: b <= here))
    dealt = df.withColumn("x_place", place).withColumn("x_row", row)
    dealt = dealt.withColumn("x_part", (F.col("x_row") - 1) * step + col - 1).drop("x_row")
    used = sorted(r.x_part for r in dealt.select("x_part").distinct().collect())  # one number a stretch
    before = F.create_map(*[F.lit(x) for part, last in zip(used, used[-1:] + used[:-1]) for x in (part, last)]) if used else None
    order = Window.partitionBy("x_part").orderBy("x_place", tie)
    heads = dealt.withColumn("x_nth", F.row_number().over(order)).where("x_nth = 1").drop("x_nth")  # at most one a stretch and task
    halo = heads.withColumn("x_part", before[F.col("x_part")] if used else F.lit(0))
    both = add(dealt).withColumn("x_halo", F.lit(False)).unionByName(add(halo).withColumn("x_halo", F.lit(True)))
    order = Window.partitionBy("x_part").orderBy("x_halo", "x_place", tie)
    out = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return out.where(~F.col("x_halo")).drop("x_place", "x_part", "x_halo")


def edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's sketch beside that of its edited text and that of the next document.

    The edited text has its last half replaced by as much of the beginning of the next
    document. Columns: doc_id, n_chars, text, edited, next_text, kept, edited_kept, next_kept.
    """
    docs = narrow(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("*", F.xxhash64("text").alias("tie"))
    followed = with_next(docs, "doc_id", ["text", "kept"], "tie", add=lambda d: d.withColumn("kept", sketch(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    made = followed.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text", "kept", "next_kept")
    return made.withColumn("edited_kept", sketch(F.col("edited")))
