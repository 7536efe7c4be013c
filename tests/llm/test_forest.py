from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunning.llm import forest, registry

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, asked, k):
    out = {}
    for q in asked:
        i = ids.index(q)
        score = forest.exact(vectors, vectors[i])
        others = [j for j in range(len(ids)) if ids[j] != q]
        out[q] = [(ids[j], score[j]) for j in sorted(others, key=lambda j: (-score[j], ids[j]))[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_strings_and_prefixes():
    rng = np.random.default_rng(0)
    points, planes = rng.normal(size=(50, 4)), rng.normal(size=(4, 3 * 8))
    made = forest.strings(points, planes, 3, 8)
    for t in range(3):
        for i in range(50):
            assert int("".join("1" if x > 0 else "0" for x in points[i] @ planes[:, t * 8 : t * 8 + 8]), 2) == made[t, i]
    a, b = np.array([0b10110000, 5, 5], np.uint64), np.array([0b10100000, 5, 133], np.uint64)
    assert forest.shared_bits(a, b, 8).tolist() == [3, 8, 0]


def test_clustered_vectors_need_few_candidates_and_are_found():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(200, 32))
    vectors = np.repeat(centres, 25, axis=0) + 0.01 * rng.normal(size=(5000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    made = forest.Forest(np.arange(5000), vectors, 1.0)
    place, ids, _ = made.search(np.arange(0, 5000, 50), vectors[::50], 20)
    expected = brute(list(range(5000)), vectors, range(0, 5000, 50), 20)
    hits = sum(len(set(ids[place == i]) & {j for j, _ in expected[q]}) for i, q in enumerate(range(0, 5000, 50)))
    assert hits / (20 * 100) > 0.98
    assert made.depth(0.99, 1.0, forest.CERTAINTY) > 10 > made.depth(0.3, 1.0, forest.CERTAINTY)


@pytest.mark.parametrize("kind", ["lengths", "ties", "copies"])
def test_search_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(forest, "FOREST_ROWS", 300)
    monkeypatch.setattr(forest, "QUERY_ROWS", 20)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(900, 8)).astype(np.float32)
    if kind == "lengths":
        vectors *= np.exp(rng.normal(size=(900, 1))).astype(np.float32)
    if kind == "ties":
        vectors = rng.integers(-1, 2, size=(900, 8)).astype(np.float32)
        vectors[(vectors == 0).all(axis=1), 0] = 1
    if kind == "copies":
        vectors[rng.permutation(900)[:400]] = vectors[0]
    df = frame(spark, [(i, vectors[i]) for i in range(900)])
    got = found(forest.search(df, F.col("vec_id") % 20 == 0, 20))
    expected = brute(list(range(900)), vectors.astype(float), range(0, 900, 20), 20)
    hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert hits / (20 * len(expected)) > 0.95
    if kind != "lengths":
        tops = [got[q] == expected[q] for q in expected]
        assert sum(tops) / len(tops) > 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [2, 1]), (2, None), (3, [0, 0]), (4, [nan, 1]), (5, [inf, 1]), (6, [None, 1]), (7, [1, 2, 3]), (None, [1, 1]), (8, []), (20, [1, 1]), (20, [1, 1]), (40, [0, 0]), (9, [-1, 0])]
    got = found(forest.search(frame(spark, rows).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)), F.col("vec_id") % 20 == 0, 20))
    assert got == {0: [(1, 2.0), (20, 1.0), (9, -1.0)], 20: [(1, 3.0), (0, 1.0), (9, -1.0)]}
    assert forest.search(frame(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert forest.search(frame(spark, [(0, [1, 0])]), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert forest.search(frame(spark, [(1, [1, 0]), (2, [1, 0])]), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    asked = [i for i in ids if i % 20 == 0]
    got = found(registry.op1_ann_prefix_forest(spark, sf))
    expected = brute(ids, vectors, asked, 20)
    assert set(got) == set(asked) and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in asked) / (20 * len(asked)) >= 0.9
    assert all(abs(dict(expected[q]).get(i, s) - s) < 1e-12 for q in asked for i, s in got[q])
