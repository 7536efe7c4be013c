"""SimHash near-duplicates: pigeonhole blocks, joined and verified.

A fingerprint has 64 bits; two fingerprints link at ``max_bits`` or fewer
differing bits. The 64 bits are cut into ``blocks`` parts; a close pair agrees
on at least ``blocks - max_bits`` of them, so every choice of that many parts is
a join key (five parts and two bits: ten keys of about 38 bits). Only distinct
fingerprints are joined, so exact copies cost one row.

A key shared by more than ``crowd`` fingerprints is not joined to itself. There
each fingerprint is listed under all values up to half the distance away (bits
of the key stay); two fingerprints are close exactly if they meet under such a
value, and all that meet there are linked to the smallest one. That is exact
and has no pairs.

Nulls and edges: a null or blank text has fingerprint zero and is linked like
any other; a null id counts as larger than every id; repeated rows share a
component; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.common import add_columns, as_bytes, checkpointed, narrow

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCKS = 5
CROWD = 32
#: Shingles hashed at once; bounds memory for a very long text.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of one UTF-8 text: a bit is 1 if it is set in over half the shingle hashes."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle_words + 1
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype(">u8"), n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = hashes[start : start + CHUNK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _kernel(shingle_words: int):
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t, shingle_words) for t in as_bytes(texts)], pa.int64())]

    return run


def with_fingerprint(df: DataFrame, text: str, out: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` and its texts' fingerprints as signed longs."""
    return add_columns(df, text, [T.StructField(out, T.LongType())], partial(_kernel, shingle_words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(blocks: int, agree: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [reduce(int.__or__, chosen) for chosen in combinations(parts, agree)]


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(u, v), u < v: enough links between distinct fingerprints ``fp`` to connect every close pair.

    Each link is itself a close pair; in crowded blocks a close pair may be
    connected through a third fingerprint close to both or to the next one.
    """
    if not 0 <= max_bits < blocks or max_bits > 4:
        raise ValueError("max_bits must be 0 to 4 and less than blocks")
    masks = _masks(blocks, blocks - max_bits)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)])
    listed = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.part")
    sizes = listed.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    listed = listed.join(sizes, ["k", "part"])

    few = listed.where(F.col("n") <= crowd)
    a = few.select("k", "part", F.col("fp").alias("u"))
    b = few.select(F.col("k").alias("k2"), F.col("part").alias("part2"), F.col("fp").alias("v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(k)) for k, m in enumerate(masks)])
    pairs = a.join(b, (F.col("k") == F.col("k2")) & (F.col("part") == F.col("part2")) & (F.col("u") < F.col("v")) & (F.bit_count(differ) <= max_bits) & (first == F.col("k"))).select("u", "v")

    near, far = max_bits // 2, (max_bits + 1) // 2
    flips = [(sum(1 << i for i in bits), r) for r in range(far + 1) for bits in combinations(range(64), r)]
    flip = F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.lit(r).alias("r")) for m, r in flips])
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("k") + 1)
    many = listed.where(F.col("n") > crowd).select("k", "fp", F.explode(F.filter(flip, lambda x: x["m"].bitwiseAND(mask) == 0)).alias("x"))
    many = many.select("k", "fp", "x.r", F.col("fp").bitwiseXOR(F.col("x.m")).alias("at"))
    centre = F.min(F.when(F.col("r") <= near, F.col("fp"))).over(Window.partitionBy("k", "at"))
    stars = many.select("fp", centre.alias("centre")).where("fp <> centre")
    stars = stars.select(F.least("fp", "centre").alias("u"), F.greatest("fp", "centre").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (u, v), for every node that has a link.

    Large-star and small-star rounds: each links neighbours straight to a
    smaller node, so the rounds needed grow with the logarithm of a chain.
    """
    edges = checkpointed(edges.select("u", "v"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every row points from a larger node to a smaller one
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("v"), F.col("m").alias("u"))
        edges = checkpointed(moved.unionByName(small.select(F.col("a").alias("v"), F.col("m").alias("u"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now


def groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): one row per distinct fingerprint of ``rows``, with the fingerprint that names its component."""
    prints = rows.select("fp").distinct()
    roots = components(links(prints, max_bits))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _smallest(doc_id: str) -> Column:
    return F.min(F.col(doc_id))  # min() leaves nulls out: a null id is chosen only if there is no other


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, fp (long) and component_id, the smallest id reachable."""
    rows = checkpointed(with_fingerprint(narrow(df, doc_id=doc_id, text=text), "text", "fp").select("doc_id", "fp"))
    classes = rows.groupBy("fp").agg(_smallest("doc_id").alias("least"))
    found = groups(rows, max_bits).join(classes, "fp")
    # a component can hold any share of the fingerprints: its smallest id is aggregated, then joined back
    named = found.groupBy("root").agg(_smallest("least").alias("component_id"))
    names = found.join(named, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (of repeated rows, one)."""
    names, i, j = df.columns, df.columns.index(doc_id), df.columns.index(text)
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    mark = F.xxhash64(F.lit(j), F.col(f"c{j}"))
    rows = with_fingerprint(narrow(df, doc_id=doc_id, text=text), "text", "fp").select("doc_id", "fp", F.xxhash64(F.lit(j), "text").alias("mark"))
    rows = checkpointed(rows)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark")))
    firsts = rows.groupBy("fp").agg(best.alias("first"))
    winners = groups(rows, max_bits).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
    winners = winners.select(F.col("first.doc_id").alias("w_id"), F.col("first.mark").alias("w_mark"))
    kept = plain.withColumn("mark", mark).join(winners, F.col(f"c{i}").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")), "left_semi")
    one = Window.partitionBy(f"c{i}", "mark").orderBy(*[f"c{k}" for k, t in enumerate(df.schema) if k != j and not isinstance(t.dataType, (T.MapType, T.ArrayType, T.StructType))] or ["mark"])
    return kept.withColumn("rn", F.row_number().over(one)).where("rn = 1").select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
