from __future__ import annotations

import bisect
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from dunning.llm import registry, sketch

LOW = (1 << 64) - 1
EDGE = -(1 << 63) + (1 << 64) // sketch.SCALE


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plain_hashes(text: str | None) -> set[int]:
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    found = []
    for i in range(max(len(words) - 4, 1) if words else 0):
        seed = 42
        for w in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", w), seed & LOW)
        found.append(signed(seed))
    return set(found)


def plain_sketch(text: str | None) -> list[int]:
    found = plain_hashes(text)
    return sorted(h for h in found if h < EDGE) or sorted(found)


def plain_rows(rows):
    order = sorted(((r[0] if r[0] is not None else -(1 << 63)), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), r[0], r[1] or "") for r in rows)
    out = []
    for k, (_, _, doc_id, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, b = (plain_sketch(t) for t in (text, edited))

        def near(t, u):
            x, y = set(plain_sketch(t)), set(plain_sketch(u))
            if not x or not y:
                return 1.0 if not x and not y else 0.0
            if (min(x) < EDGE) != (min(y) < EDGE):
                x, y = plain_hashes(t), plain_hashes(u)
            return len(x & y) / min(len(x), len(y))

        as_text = ["".join(f"{h % (1 << 64):016x}" for h in s) for s in (a, b)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *as_text, near(text, edited), near(text, nxt)))
    return out


def rows_of(kind: str):
    rng = random.Random(kind)
    words = [f"w{i}" for i in range(200)] + ["é", "🙂", "A", "a\x85b"]
    text = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 8, 60, 300])))
    if kind == "empty":
        return []
    if kind == "one":
        return [(5, "one two three four five six seven")]
    if kind == "repeats":
        return [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other text"), (None, None), (None, "null id"), (9, None), (2, "")] + [(50, text()) for _ in range(40)]
    if kind == "hot":  # a third without an id, a third with one id, texts that differ
        return [(None, f"null {k} " + text()) for k in range(150)] + [(7, f"seven {k} " + text()) for k in range(150)] + [(k, text()) for k in range(150)]
    return [(i * i if i % 2 else -i, text()) for i in range(300)] + [(10**15, "far " * 20000)]


@pytest.mark.parametrize("kind", ["empty", "one", "repeats", "many", "hot"])
@pytest.mark.parametrize("stretch", [7, 1024])
def test_query_against_brute_force(spark, make_docs, stored, kind, stretch, monkeypatch):
    monkeypatch.setattr(sketch, "STRETCH_ROWS", stretch)
    rows = rows_of(kind)
    docs = make_docs(rows).withColumn("kept", F.lit("x")).withColumn("x_part", F.lit(1)).withColumn("tie", F.lit(2))
    got = [tuple(r) for r in registry.op9_scaled_sketch(spark, stored(documents=docs)).collect()]
    assert sorted(got, key=str) == sorted(plain_rows(rows), key=str)


def test_merging_and_containment(spark, make_docs):
    rng = random.Random(2)
    small = [f"a{rng.random()}" for _ in range(400)]
    large = [f"b{rng.random()}" for _ in range(20000)]
    docs = make_docs([(1, " ".join(small)), (2, " ".join(large)), (3, " ".join(large + small)), (4, " ".join(small[:200] + large))])
    made = docs.select("doc_id", sketch.sketch(F.col("text")).alias("k"))
    by = {r.doc_id: r.k for r in made.collect()}
    both = made.where("doc_id <= 2").agg(sketch.merged(F.col("k")).alias("m")).first().m
    assert set(both) <= set(by[3]) and len(set(by[3]) - set(both)) <= 4  # the joint holds four more shingles
    pairs = made.alias("a").join(made.alias("b"), F.col("a.doc_id") < F.col("b.doc_id"))
    share = {(r[0], r[1]): r[2] for r in pairs.select(F.col("a.doc_id"), F.col("b.doc_id"), sketch.contained(F.col("a.k"), F.col("b.k"))).collect()}
    assert share[(1, 3)] > 0.98 and abs(share[(1, 4)] - 0.5) < 0.15 and share[(1, 2)] == 0


def test_main_path_has_no_python(spark):
    plan = registry.op9_scaled_sketch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|SinglePartition", plan)


def test_short_passages_inside_long_texts_are_found(spark, make_docs, stored):
    """Each passage of 1 to 10 shingles is followed by a long text that holds it, or by one that does not."""
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(200):
        long = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        shingles, held, at = k % 10 + 1, k % 4 > 0, rng.randrange(300)
        rows += [(2 * k, " ".join(long[at : at + shingles + 4] if held else [f"x{rng.random()}" for _ in range(shingles + 4)])), (2 * k + 1, " ".join(long))]
        want[2 * k] = float(held)
    got = {r.doc_id: r.near_next for r in registry.op9_scaled_sketch(spark, stored(documents=make_docs(rows))).collect()}
    assert {i: got[i] for i in want} == want


def test_sketches_that_cannot_tell_say_so(spark, make_docs):
    texts = [f"a{k} b{k} c{k} d{k} e{k}" for k in range(60)] + [" ".join(f"z{k}" for k in range(500)), ""]
    made = make_docs(list(enumerate(texts))).select("doc_id", sketch.sketch(F.col("text")).alias("k"))
    by = {r.doc_id: r.k for r in made.collect()}
    pairs = made.alias("x").join(made.alias("y"), F.lit(True)).select(F.col("x.doc_id"), F.col("y.doc_id"), sketch.likeness(F.col("x.k"), F.col("y.k")), sketch.contained(F.col("x.k"), F.col("y.k")))
    for i, j, near, share in pairs.collect():
        a, b = by[i], by[j]
        if not a or not b:
            assert near == share == float(not a and not b)
        elif (min(a) < EDGE) != (min(b) < EDGE):
            assert near is None and share is None
        else:
            assert near == len(set(a) & set(b)) / min(len(a), len(b)) and share == len(set(a) & set(b)) / len(a)


def test_a_hot_id_is_spread_over_stretches(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sketch, "STRETCH_ROWS", 20)
    docs = make_docs([(None, f"null {k}") for k in range(1000)] + [(k, f"own {k}") for k in range(2000)])
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("tie"))
    place = F.coalesce("doc_id", F.lit(sketch.FIRST))
    bounds = sketch._bounds(rows, place, "tie")
    keyed = sorted((r[0], r[1]) for r in rows.select(place, "tie").collect())
    starts = [bisect.bisect_left(keyed, b) for b in bounds] + [len(keyed)]
    assert max(b - a for a, b in zip(starts, starts[1:])) < 100  # 1,000 rows share the null id
