from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dunning.llm import line_dedup, registry

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "All rights reserved by whoever holds them, in every land. "


def plain(rows):
    docs: dict[str, set] = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(WHITE).translate(LOWER)
    low = lambda i: -(1 << 63) if i is None else i
    for i, lines in split:
        for line in lines:
            docs.setdefault(key(line), set()).add(low(i))
    falls = {k: max(d) for k, d in docs.items() if len(k) >= 40 and len(d) >= 5}
    out = []
    for i, lines in split:
        kept = [x for x in lines if low(i) >= falls.get(key(x), low(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def rows_of(kind: str):
    rng = random.Random(kind)
    pool = [LONG + str(k) for k in range(12)] + ["é🙂" * 20, "é🙂" * 19, "short", "", "x" * 40, "X" * 40, "\x0b" + "y" * 39, " " + "z" * 40]
    line = lambda: rng.choice(["", " ", "\t\r"]) + rng.choice([str, str.upper])(rng.choice(pool)) + rng.choice(["", "\x0c "])
    text = lambda: "\n".join(line() for _ in range(rng.choice([0, 1, 2, 5, 30])))
    if kind == "empty":
        return []
    if kind == "four":
        return [(k, LONG) for k in range(4)] + [(3, LONG + "\n" + LONG)]
    if kind == "hot":
        return [(k, "\n".join([LONG] * 40 + [f"line number {k} of its own, and nowhere else at all"])) for k in range(60)]
    if kind == "repeats":
        return [(1, LONG + "\na"), (1, LONG + "\na"), (1, "other\n" + LONG), (None, LONG), (None, None), (7, ""), *[(k, LONG.upper() + "\n" * k) for k in range(2, 6)]]
    return [(k * 3 - 50, text()) for k in range(120)] + [(10**12, "\n".join([LONG + str(k % 90) for k in range(3000)])), (5, "\n" * 5000)]


@pytest.mark.parametrize("kind", ["empty", "four", "hot", "repeats", "many"])
@pytest.mark.parametrize("hot", [(1000, 1000), (20, 3)])
def test_query_against_brute_force(spark, make_docs, stored, kind, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot[0])
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot[1])
    monkeypatch.setattr(line_dedup, "BINS", 64)
    docs = make_docs(rows_of(kind)).withColumn("x_doc", F.lit(1)).withColumn("KEEP", F.lit("x")).withColumn("pos", F.lit(2))
    got = [tuple(r) for r in registry.op12_line_dedup(spark, stored(documents=docs)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows_of(kind)), key=str)


def test_bitmaps_hold_no_text_and_rebuild_it(make_docs):
    rows = rows_of("many")
    docs = make_docs(rows)
    made = line_dedup.with_bitmaps(docs)
    assert made.columns == ["doc_id", "n_lines", "n_dropped", "keep"]
    texts = dict(rows)
    want = {i: (n, gone) for i, n, gone, _ in plain(rows)}
    for r in made.collect():
        lengths = [k.length for k in r.keep]
        assert (r.n_lines, r.n_dropped) == want[r.doc_id] and sum(lengths) == r.n_lines - r.n_dropped and 0 not in lengths
        assert all(a.start + a.length < b.start for a, b in zip(r.keep, r.keep[1:]))  # runs are as long as they can be
        lines = (texts[r.doc_id] or "").split("\n")
        kept = [x for k in r.keep for x in lines[k.start : k.start + k.length]]
        assert all(line in lines for line in kept)


def test_main_path_has_no_python_and_one_range_exchange(spark):
    plan = registry.op12_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SinglePartition|CartesianProduct|BroadcastNestedLoop", plan)
    windows = plan[plan.index("Window ") :]
    assert re.search(r"rangepartitioning\(h1#\d+L ASC NULLS FIRST, h2#\d+L ASC NULLS FIRST", windows)
    assert not re.search(r"hashpartitioning\(h1", windows)  # the window reads the range partitions as they are
