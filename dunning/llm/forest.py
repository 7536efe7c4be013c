"""Approximate nearest neighbours by inner product: a hash-prefix forest.

A tree is a sorted array of long hash strings, one per vector: the signs of
``BITS`` random projections. A query descends to the longest prefix it shares with
any string of each tree, then all trees ascend together, one bit of prefix at a
time, and the strings that share the shorter prefix become candidates. Inner
products turn into angles by one more component, which fills every vector to the
largest length (0 for queries).

The ascent stops when it has as many candidates as asked for and a vector as near as the
worst of them would have shared a prefix this long in some tree with probability
``CERTAINTY``; it needs no cap on candidates. The farther a query's neighbours, the shorter the prefix it
ascends to; at certainty 1 that is the empty one, which all vectors share: the exact search.

Vectors are dealt into forests of ``FOREST_ROWS`` by a hash of their id. A task builds a forest once
and streams the queries past it; the best found are merged per query. Every vector is indexed.

Nulls and edges: vectors that are null, zero, of another than the commonest length, or
hold a null or non-finite component, and rows without an id, take no part; of rows
with one id the smallest vector counts. Ties go to the smaller id. With fewer candidates than
asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.llm.common import checkpointed, narrow

TREES, BITS = 24, 32
CERTAINTY = 0.94
#: Vectors of a forest, on average over the hash, and queries whose prefixes are looked up at once.
FOREST_ROWS, QUERY_ROWS = 65_536, 512
SEED = 1


def clean(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, one per id."""
    rows = narrow(df, vec_id=vec_id, v=vector).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    rows = rows.where(~F.coalesce(bad, F.lit(False)) & ~F.coalesce(zero, F.lit(False)) & (F.size("v") > 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def projections(dims: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, trees * bits))


def strings(points: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings (trees x points) as unsigned numbers, first bit highest."""
    out = np.zeros((trees, len(points)), np.uint64)
    for start in range(0, len(points), 1024):
        signs = (points[start : start + 1024] @ planes > 0).reshape(-1, trees, bits)
        out[:, start : start + 1024] = (signs @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.float64)).astype(np.uint64).T
    return out


def shared_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix."""
    differ = (a ^ b).astype(np.float64)  # exact up to 2^53
    return bits - np.frexp(differ)[1]


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, the same for equal vectors wherever they stand."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d] * query[d]
    return total


def nearest(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class Forest:
    """Sorted arrays over some vectors. ``longest``: the largest length of any vector of the whole table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.ids, self.vectors, self.longest, self.trees, self.bits = ids, vectors, longest, trees, bits
        self.rough = vectors.astype(np.float32)
        self.scored = 0
        scaled = vectors / longest
        filler = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
        self.planes = projections(vectors.shape[1], trees, bits, seed)
        made = strings(np.c_[scaled, filler], self.planes, trees, bits)
        self.order = np.argsort(made, axis=1, kind="stable")
        self.sorted = np.take_along_axis(made, self.order, axis=1)

    def depth(self, score: float, length: float, certainty: float) -> float:
        """Longest prefix at which a vector with this inner product is met in some tree with the certainty."""
        angle = math.acos(min(max(score / (length * self.longest), -1.0), 1.0))
        agree = 1 - angle / math.pi
        if agree >= 1:
            return math.inf
        if agree <= 0:
            return 0.0
        return math.log(1 - (1 - certainty) ** (1 / self.trees)) / math.log(agree)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, certainty: float = CERTAINTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids found and their scores: each query's ``k`` nearest other vectors."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        own = strings(np.c_[queries / lengths[:, None], np.zeros(len(queries))], self.planes, self.trees, self.bits)
        n = len(self.ids)
        longest = np.zeros(len(queries), int)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], own[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                longest = np.maximum(longest, shared_bits(self.sorted[t][near], own[t], self.bits))
        lows, highs = [], []  # per prefix length: the range of each tree and query
        for length in range(self.bits + 1):
            rest = np.uint64(self.bits - length)
            low = own >> rest << rest
            lows.append(np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, low, strict=True)]))
            highs.append(np.stack([np.searchsorted(s, q, "right") for s, q in zip(self.sorted, low + (np.uint64(1) << rest) - np.uint64(1), strict=True)]))
        out = []
        for q in range(len(queries)):
            seen = np.zeros(n, bool)
            places, scores, met, worst = [], [], 0, -math.inf
            length, query = int(longest[q]), queries[q].astype(np.float32)
            while True:
                fresh = np.zeros(n, bool)
                for t in range(self.trees):
                    fresh[self.order[t, lows[length][t, q] : highs[length][t, q]]] = True
                fresh &= ~seen
                seen |= fresh
                new = np.flatnonzero(fresh)
                new = new[self.ids[new] != ids[q]]
                if len(new):
                    places.append(new)
                    scores.append(self.rough[new] @ query)
                    met += len(new)
                    if met >= k:
                        worst = float(np.partition(np.concatenate(scores), -k)[-k])
                if length == 0 or worst > -math.inf and self.depth(worst, lengths[q], certainty) >= length:
                    break
                length -= 1
            self.scored += met
            if met:
                place, score = np.concatenate(places), np.concatenate(scores)
                out.append(self._best(q, queries[q], place[score >= worst - self._slack(lengths[q])], k))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))

    def _slack(self, length: float) -> float:
        """More than single precision and the summing order can change an inner product."""
        return 1e-4 * length * self.longest

    def _best(self, q: int, query: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = exact(self.vectors[place], query)
        best = nearest(self.ids[place], score, k)
        return np.full(len(best), q), self.ids[place][best], score[best]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _meet(batches: Iterator[pa.RecordBatch], longest: float, k: int, certainty: float) -> Iterator[pa.RecordBatch]:
    """Rows (forest, asks, vec_id, v) in this order: each forest is built from its vectors, then its queries pass."""
    at, forest, ids, vectors = None, None, [], []
    for batch in batches:
        asks, forests = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
        numbers = batch.column(2).to_numpy(zero_copy_only=False)
        values = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        cuts = [0, *(np.flatnonzero((np.diff(forests) != 0) | (np.diff(asks) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if a == b:
                continue
            if forests[a] != at:
                at, forest, ids, vectors = forests[a], None, [], []
            if not asks[a]:
                ids.append(numbers[a:b])
                vectors.append(values[a:b])
                continue
            if forest is None and ids:
                forest, ids, vectors = Forest(np.concatenate(ids), np.concatenate(vectors), longest), [], []
            for start in range(a, b, QUERY_ROWS) if forest else ():
                part = slice(start, min(start + QUERY_ROWS, b))
                place, found, score = forest.search(numbers[part], values[part], k, certainty)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[part][place], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], schema=FOUND)


def search(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", certainty: float = CERTAINTY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others found for each vector for which ``is_query`` (over ``vec_id``) holds."""
    rows = checkpointed(clean(df, vec_id, vector))
    by_size = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = by_size.dims if by_size else 0
    rows = rows.where(F.size("v") == dims)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("square")).first()
    forests = max(1, math.ceil(facts.n / FOREST_ROWS))
    indexed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(forests)).alias("forest"), F.lit(0).alias("asks"), "vec_id", "v")
    asking = rows.where(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(forests - 1).cast("long"))).alias("forest"), F.lit(1).alias("asks"), "vec_id", "v")
    order = ["forest", "asks", "vec_id"]
    # a query goes to each forest once; vectors go to their own forest alone
    met = indexed.unionByName(asking).repartition("forest").sortWithinPartitions(*order)
    longest = math.sqrt(facts.square or 1.0)
    found = met.mapInArrow(lambda batches: _meet(batches, longest, k, certainty), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
