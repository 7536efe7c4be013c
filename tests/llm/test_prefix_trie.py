from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dunning.llm import prefix_trie, registry

COLS = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    nodes: dict[tuple, dict] = {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5  # towards zero
        turns = convs[c] if base == c else convs.get(base, [])[:h] + convs[c][h:]
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(str(c))
    for n in nodes.values():
        n |= {"kids": 0, "leaves": 0, "saved": 0}
    for path in sorted(nodes, key=len, reverse=True):
        n = nodes[path]
        n["leaves"] = n["leaves"] or 1
        n["saved"] += (len(n["members"]) - 1) * len(path[-1][1].encode()) if path else 0
        if path:
            up = nodes[path[:-1]]
            up["kids"] += 1
            up["leaves"] += n["leaves"]
            up["saved"] += n["saved"]
    return [
        (n["members"][0], len(p), nodes[p[:-1]]["members"][0] if p else None, len(n["members"]), n["kids"], n["leaves"], n["saved"], hashlib.sha256(",".join(n["ends"]).encode()).hexdigest())
        for p, n in nodes.items()
    ]


def rows_of(kind: str):
    rng = random.Random(kind)
    if kind == "empty":
        return []
    if kind == "turnless":
        return [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 11, 12)] + [(None, 0, "user", "lost")]
    if kind == "edges":
        same = [(c, k, None if k % 2 else "", None if k == 3 else "é" * k) for c in range(10, 20) for k in range(6)]
        return same + [(2**63 - 1, None, "a", "b"), (2**63 - 1, 0, "a", ":b"), (-(2**63), 1, "a:", "b"), (-7, 1, "u", "v"), (-5, 2, "u", "w"), (-5, None, "u", "v"), (0, 1, "u", "v"), (-3, 9, "u", "v")]
    texts = ["hello", "yes", "no", "🙂 ok", "", "long " * 200]
    rows = [(c, t, ("user", "assistant")[t % 2], texts[0] if t < 3 else rng.choice(texts)) for c in range(150) for t in range(rng.choice([1, 2, 5, 9, 14]))]
    if kind == "long":
        rows += [(c, t, "user", rng.choice(texts[:2]) if c == 205 else f"t{t}") for c in (200, 202, 205) for t in range(700)]
        rows += [(c, t, "user", "copy") for c in range(300, 360) for t in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["empty", "turnless", "edges", "many", "long"])
@pytest.mark.parametrize("unit", [None, 7, 2])
def test_trie_against_brute_force(spark, kind, unit):
    rows = rows_of(kind)
    turns = spark.createDataFrame(rows, COLS).withColumn("ID", F.lit(1)).withColumn("top", F.lit("x")).withColumn("place", F.lit(2))
    got = [tuple(r) for r in prefix_trie.trie(turns, unit).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_query(spark, stored):
    rows = rows_of("many")
    got = [tuple(r) for r in registry.op11_prefix_trie(spark, stored(conversations=spark.createDataFrame(rows, COLS))).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_turns_of_equal_number_have_a_fixed_order(spark):
    rows = [(5, 1, "u", "a"), (5, 1, "u", "b"), (5, 1, "u", "b"), (5, None, "u", "c"), (10, 1, "u", "b"), (10, 1, "u", "a"), (10, 1, "u", "b"), (10, None, "u", "c")]
    for _ in range(2):
        random.Random(3).shuffle(rows)
        got = {(r.depth, r.n_convs) for r in prefix_trie.trie(spark.createDataFrame(rows, COLS)).collect()}
        assert got == {(d, 2) for d in range(5)}


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_mail_comes_in_order_and_spills(held, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HELD", held)
    rng = random.Random(held)
    mail, sent = prefix_trie.Mail(), []
    for k in range(500):
        sent.append(((-rng.randrange(5), bytes([rng.randrange(8)])), (k, "x" * k)))
        mail.send(*sent[-1])
    assert bool(mail.runs) == (held < 500)
    for at in sorted({to for to, _ in sent}):
        assert sorted(mail.receive(at)) == [what for to, what in sent if to == at]
    assert not mail.heap and not mail.runs


def test_members_of_one_node_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    ids = [5, 40, 41, 1000, 10**12, 10**15]
    made = list(prefix_trie.pieces(iter([(b"a", 3), *[(b"b", c) for c in ids]])))
    assert len(made) > 3
    want = [(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in ((b"a", "3"), (b"b", ",".join(map(str, ids))))]
    assert list(prefix_trie.digests(iter(made))) == want
