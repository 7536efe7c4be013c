"""Source divergence audit: how far the word counts of a language's sources lie apart.

Terms (runs of letters; everything outside ASCII counts as a letter; A-Z lower-cased) that stand
in at least ``KEPT_DOCS`` documents of a language are kept. Within a language a group (source) with
N kept occurrences gives a kept term with ``count`` of them, of V kept terms in all, the price
p = 1 + floor(``UNIT`` * (count + ``SMOOTH``) / (N + ``SMOOTH`` * V)). Two groups differ by the sum of
|p - p'| over all kept terms, those they lack included; a group's telling terms are those it
prices above the whole language.

Counting is a numpy kernel over some MB of text at a time; Spark sums its rows. For the
differences the terms of a language are dealt into blocks by hash, and its sources into tiles.
A block holds one segment tree of counts per source, hash-consed: equal subtrees of all trees
are one node. Two trees are walked together from the roots down, level by level for all pairs
of sources at once; a pair of nodes that a pair of sources has met before on a level is
not followed again, and what it costs is counted once. All sums are exact integers.

Nulls and edges: null text, language or source is the empty string; a group without
terms, or without kept ones, has N = 0; a language without kept terms has difference 0
everywhere and no telling terms; repeated rows are further documents; very long texts are
counted whole; an empty table gives an empty one. Every unit of work holds two tiles of
sources and one block of terms, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.llm.common import checkpointed, narrow

KEPT_DOCS, SMOOTH, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a block and sources of a tile, on average over the hash.
BLOCK_TERMS, TILE_SOURCES = 2048, 64
#: Bytes of text that are counted at once (a longer text goes alone).
COUNT_BYTES = 16_000_000
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PAD = -1
GROUP = ["lang", "source"]
TERM = ["lang", "term"]


def _count(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    """lang, source, term, n, docs of some documents."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[ends[0] : ends[-1]].translate(LETTERS) if texts.buffers()[2] else b""
    ends = ends - ends[0]
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]  # a term never runs from one text into the next
    opens[cut] |= inside[cut]
    closes[cut - 1] |= inside[cut - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(ends, starts, "right") - 1
    upto = np.r_[0, np.cumsum(stops - starts)].astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(raw[inside])])
    coded = tokens.dictionary_encode()
    codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    wide = max(len(terms), 1)
    pairs, times = np.unique(doc * wide + codes, return_counts=True)
    groups = pa.StructArray.from_arrays([lang, source], GROUP)
    names = sorted({(g["lang"], g["source"]) for g in groups.to_pylist()})
    place = {g: i for i, g in enumerate(names)}
    of_doc = np.array([place[(g["lang"], g["source"])] for g in groups.to_pylist()], np.int64)
    key = of_doc[pairs // wide] * wide + pairs % wide if len(pairs) else pairs
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else order
    kept = key[order][first]
    n = np.add.reduceat(times[order], first) if len(first) else times
    docs = np.diff(np.r_[first, len(key)])
    take = lambda k: pa.array([g[k] for g in names], pa.string()).take(pa.array(kept // wide))
    return pa.RecordBatch.from_arrays([take(0), take(1), terms.take(pa.array(kept % wide)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=[*GROUP, "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            made = _count(*[pa.concat_arrays([b.column(i) for b in held]) for i in range(3)])
            for at in range(0, made.num_rows, 65536):
                yield made.slice(at, 65536)
        held.clear()

    for batch in batches:
        upto = np.r_[0, np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, upto[start] + max(COUNT_BYTES - size, 0), "right")) - 1
            stop = min(max(stop, start + (not held)), batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(upto[stop] - upto[start])
            if stop < batch.num_rows or size >= COUNT_BYTES:
                yield from flush()
                size = 0
            start = stop
    yield from flush()


def documents_of(df: DataFrame) -> DataFrame:
    rows = narrow(df, text="text", lang="lang", source="source")
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n of the kept terms; lang_n: the term's count in the language; first: one row per term."""
    seen = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = seen.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy(*TERM)
    over = counts.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "nth": F.row_number().over(term.orderBy("source"))})
    return over.where(F.col("in_docs") >= KEPT_DOCS).select(*GROUP, "term", "n", "lang_n", (F.col("nth") == 1).alias("first"))


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (N), and of the language: lang_size, terms (V), sources."""
    sizes = kept.groupBy(*GROUP).agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("firsts"))
    every = docs.select(*GROUP).distinct().join(sizes, GROUP, "left").fillna(0, ["size", "firsts"])
    langs = every.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("firsts").alias("terms"), F.count(F.lit(1)).alias("sources"))
    return every.drop("firsts").join(langs, "lang")


def price(count: str, size: str) -> Column:
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * (cast({count} as decimal(20,0)) + {SMOOTH})) div (cast({size} as decimal(20,0)) + {SMOOTH} * cast(terms as decimal(15,0)))")


def telling_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of each group's terms priced above the language, ``TOP_TERMS`` at most."""
    priced = kept.join(groups, GROUP).select(*GROUP, F.col("term").alias("item"), (price("n", "size") - price("lang_n", "lang_size")).alias("value"))
    return ranked(priced.where("value > 0")).where(F.col("rank") <= TOP_TERMS)


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")))


# ------------------------------------------------------------ segment trees
def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Trees over the rows of ``leaves`` (their width a power of two) with shared nodes.

    Returns the root of each row, per level from the root down the children of its nodes, and
    the count that each leaf node stands for.
    """
    values, ids = np.unique(leaves, return_inverse=True)
    ids, levels = ids.reshape(leaves.shape).astype(np.int64), []
    while ids.shape[1] > 1:
        n = int(ids.max()) + 1
        nodes, up = np.unique(ids[:, 0::2] * n + ids[:, 1::2], return_inverse=True)
        levels.append((nodes // n, nodes % n))
        ids = up.reshape(len(ids), -1).astype(np.int64)
    return ids[:, 0], levels[::-1], values


def walk(roots: np.ndarray, levels: list, values: np.ndarray, a: np.ndarray, b: np.ndarray, cost) -> np.ndarray:
    """Cost of every pair (a, b) of trees: each pair of nodes is followed and priced once per pair of trees.

    ``cost(pair, x, y)`` prices counts x and y of the trees of a pair.
    """
    at = (np.arange(len(a)), roots[a], roots[b])
    ways = []
    for left, right in levels:
        n = int(max(left.max(), right.max())) + 1
        keys = np.concatenate([(at[0] * n + side[at[1]]) * n + side[at[2]] for side in (left, right)])
        met, way = np.unique(keys, return_inverse=True)
        ways.append(way.reshape(2, -1))
        at = (met // (n * n), met // n % n, met % n)
    total = cost(at[0], values[at[1]], values[at[2]])
    for left, right in reversed(ways):
        total = total[left] + total[right]
    return total


def _prices(count: np.ndarray, size: np.ndarray, terms: int) -> np.ndarray:
    big = len(count) and (int(count.max()) + SMOOTH) * UNIT >= 1 << 63
    count, size = (x.astype(object) if big else x for x in (count, size))  # Python's integers where 64 bits are too few
    return (1 + UNIT * (count + SMOOTH) // (size + SMOOTH * terms)).astype(np.int64)


def unit_differences(rows: pa.Table) -> pa.Table:
    """a, b, value over one block of terms for all pairs of sources of one or two tiles (a before b)."""
    cols = {c: rows.column(c).to_pylist() for c in rows.column_names}
    heads = [i for i, t in enumerate(cols["term"]) if t is None]
    members = sorted({(cols["source"][i], cols["tile"][i], cols["size"][i]) for i in heads}, key=lambda m: m[0].encode())
    lang, one, two, here, terms = (cols[c][heads[0]] for c in ("lang", "t1", "t2", "here", "terms"))
    place = {m[0]: i for i, m in enumerate(members)}
    sums: dict[str, int] = {}
    for t, n in zip(cols["term"], cols["n"]):
        if t is not None:
            sums[t] = sums.get(t, 0) + n
    column = {t: i for i, t in enumerate(sorted(sums, key=lambda t: (-sums[t], t)))}  # alike counts side by side
    tile = np.array([m[1] for m in members])
    if one == two:
        a, b = np.triu_indices(len(members), 1)
    else:
        x, y = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        a, b = np.minimum(a, b), np.maximum(a, b)
    value = np.zeros(len(a), np.int64)
    if here and len(a):
        leaves = np.full((len(members), 1 << (here - 1).bit_length()), PAD, np.int64)
        leaves[:, :here] = 0
        for s, t, n in zip(cols["source"], cols["term"], cols["n"]):
            if t is not None:
                leaves[place[s], column[t]] = n
        size = np.array([m[2] for m in members], np.int64)

        def cost(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            apart = np.abs(_prices(np.maximum(x, 0), size[a[pair]], terms) - _prices(np.maximum(y, 0), size[b[pair]], terms))
            return np.where(x == PAD, 0, apart)

        value = walk(*consed(leaves), a, b, cost)
    names = pa.array([m[0] for m in members], pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})


def source_differences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every source against every other one of its language."""
    n_blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1))
    n_tiles = F.ceil(F.col("sources") / TILE_SOURCES)
    laid = groups.select("*", n_blocks.alias("blocks"), n_tiles.alias("tiles"), F.pmod(F.xxhash64("source"), n_tiles).alias("tile"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    here = kept.where("first").join(laid, GROUP).groupBy("lang", block).agg(F.count(F.lit(1)).alias("here"))
    heads = laid.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(here, ["lang", "block"], "left")
    heads = heads.select(*laid.columns, "block", F.coalesce("here", F.lit(0)).alias("here"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"))
    counts = kept.join(laid, GROUP).select(*laid.columns, block, F.lit(0).cast("long").alias("here"), "term", "n")
    met = heads.unionByName(counts).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = [F.least("other", "tile").alias("t1"), F.greatest("other", "tile").alias("t2")]
    rows = met.select("lang", "block", *pair, "source", "tile", "size", "terms", "here", "term", "n")
    parts = rows.groupBy("lang", "block", "t1", "t2").applyInArrow(unit_differences, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return ranked(sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value"))


def audit(df: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    docs = documents_of(df)
    kept = checkpointed(kept_counts(docs))
    groups = groups_of(docs, kept)
    parts = [("pair", source_differences(kept, groups)), ("term", telling_terms(kept, groups))]
    pair, term = (p.select(*GROUP, F.lit(name).alias("part"), "item", "value", "rank") for name, p in parts)
    return pair.unionByName(term)
