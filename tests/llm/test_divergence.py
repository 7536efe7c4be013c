from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dunning.llm import divergence, registry

WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return [w.translate(LOWER) for w in WORDS.findall(text or "")]


def plain(rows):
    rows = [(terms_of(r[1]), r[2] or "", r[3] or "") for r in rows]
    groups: dict[tuple, Counter] = {}
    docs: dict[str, Counter] = {}
    for terms, lang, source in rows:
        groups.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, seen in docs.items():
        kept = [t for t, n in seen.items() if n >= 30]
        mine = {s: {t: c[t] for t in kept} for (l, s), c in groups.items() if l == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}

        def prices(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in mine.items()}, prices(whole)
        for s in mine:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, 10**9), ("term", term, 50)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(order[:most], 1)]
    return out


def rows_of(kind: str):
    rng = random.Random(kind)
    words = [f"Wor{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "é", "naïve", "日本", "a\u0085b", "_x_", "ſ", "K"]
    text = lambda: rng.choice([" ", "1", "\n", "-"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 20, 80])))
    if kind == "empty":
        return []
    if kind == "rare":
        return [(k, "alpha beta", "en", f"s{k % 3}") for k in range(29)] + [(90, None, "en", None), (91, "", None, None)]
    if kind == "repeats":
        return [(1, "Same words here", "en", "a")] * 31 + [(2, "same", None, "a"), (None, None, None, None), (3, "1 2 3", "en", "b")]
    return [(k, text(), rng.choice(["en", "en", "de", None]), rng.choice([None, "hot", "hot", "hot", "ü", "u", "S9", "S10"])) for k in range(400)] + [(10**6, "wora " * 50000, "en", "long")]


@pytest.mark.parametrize("kind", ["empty", "rare", "repeats", "many"])
@pytest.mark.parametrize("block,tile", [(2048, 64), (16, 2)])
def test_query_against_brute_force(spark, make_docs, stored, kind, block, tile, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    rows = rows_of(kind)
    docs = make_docs(rows).withColumn("term", F.lit("x")).withColumn("Size", F.lit(1)).withColumn("first", F.lit(2))
    got = [tuple(r) for r in registry.op13_source_divergence(spark, stored(documents=docs)).collect()]
    assert sorted(got) == sorted(plain(rows))


def test_batches_of_any_size_count_alike(monkeypatch):
    rows = rows_of("many")
    table = pa.table({"text": [r[1] for r in rows], "lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows]})
    want = Counter()
    docs = Counter()
    for r in rows:
        t = terms_of(r[1])
        want.update({(r[2] or "", r[3] or "", x): n for x, n in Counter(t).items()})
        docs.update({(r[2] or "", r[3] or "", x) for x in t})
    for limit in (1, 500, 10**9):
        monkeypatch.setattr(divergence, "COUNT_BYTES", limit)
        n, d = Counter(), Counter()
        for b in divergence._counted(iter(table.to_batches(max_chunksize=37))):
            for r in b.to_pylist():
                n[(r["lang"], r["source"], r["term"])] += r["n"]
                d[(r["lang"], r["source"], r["term"])] += r["docs"]
        assert n == want and d == docs


def test_equal_subtrees_are_one_node_and_equal_pairs_are_priced_once():
    leaves = np.zeros((3, 1024), np.int64)
    leaves[0, 5] = leaves[1, 900] = 7
    leaves[2] = np.tile([1, 2, 3, 4], 256)
    roots, levels, values = divergence.consed(leaves)
    assert len(values) == 6 and sum(len(left) for left, _ in levels) < 60  # of 3 x 1023 inner nodes
    asked = []

    def cost(pair, x, y):
        asked.append(len(pair))
        return np.abs(x - y)

    a, b = np.array([0, 0, 1]), np.array([1, 2, 2])
    got = divergence.walk(roots, levels, values, a, b, cost)
    assert got.tolist() == [np.abs(leaves[i] - leaves[j]).sum() for i, j in zip(a, b)] and asked[0] <= 3 + 5 + 5


def test_prices_beyond_64_bits_are_exact():
    count, size = [10**12, 3, 0], [10**15, 10**15, 7]
    got = divergence._prices(np.array(count), np.array(size), 11)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (s + 55) for c, s in zip(count, size)]
