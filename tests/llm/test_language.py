from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunning.llm import registry, string_kernel
from dunning.llm.common import remainder

SF = "/root/testdata/sf0.1"


def plain_grams(text: str) -> set[str]:
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    padded = f" {' '.join(letters.split())} " if letters.split() else " "
    return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} if text else set()


@pytest.mark.parametrize("window", [1, 2, 5, 1000])
def test_grams_are_the_plain_ones(window):
    texts = ["Ab c", "", "x", "!!", "a1b", "É é\n\nÉ", "  lead", "🙂a", "漢字 かな"]
    made = list(string_kernel.grams(texts, window))
    code, doc = np.concatenate([c for c, _ in made]), np.concatenate([d for _, d in made])
    for d, text in enumerate(texts):
        found = set()
        for c in np.unique(code[doc == d]):
            chars, c = "", int(c)
            while c:
                chars = (" " if c & 0x1FFFFF == 1 else chr((c & 0x1FFFFF) - 2)) + chars
                c >>= 21
            found.add(chars)
        assert found == plain_grams(text), text


def test_presence_rows_give_the_kernel():
    texts = ["the cat", "the hat", "der hut", ""]
    sets = [set(string_kernel.gram_set(t).tolist()) for t in texts]
    vocabulary = np.unique(np.concatenate([np.array(sorted(s), np.uint64) for s in sets if s]))
    rows = string_kernel.Presence(vocabulary).rows(texts)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            expected = len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0
            assert np.isclose(rows[i] @ rows[j], expected, atol=1e-6)


def test_edges(spark, make_docs):
    en, de = "the cat and the dog were here", "der Hund und die Katze waren hier"
    docs = make_docs([(1, en, "en"), (2, de, "de"), (3, None, "en"), (4, "", "de"), (5, "12 !?", None), (None, en, "en"), (6, "漢字", None), (2, de, "de"), (7, en * 4000, None), (8, de, None)]).withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(0))
    model = string_kernel.train(docs)
    got = {(r.doc_id, r.text): (r.p, r.s) for r in string_kernel.with_language(docs, model, lang="p", score="s").collect()}
    assert got[(3, None)] == got[(4, "")] == got[(5, "12 !?")] == ("und", 0.0)
    assert got[(6, "漢字")][0] in ("en", "de") and got[(7, en * 4000)][0] == "en" and got[(8, de)][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert string_kernel.train(docs.where("false")) is None
    none = string_kernel.with_language(docs, string_kernel.train(docs.withColumn("lang", F.lit(None).cast("string"))), lang="p", score="s")
    assert {(r.p, r.s) for r in none.collect()} == {("und", 0.0)}
    one = string_kernel.train(docs.where("lang = 'en'"))
    assert {r.p for r in string_kernel.with_language(docs, one, lang="p", score="s").collect()} == {"und", "en"}


def test_training_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (string_kernel.train(d, remainder(F.col("doc_id"), 3) != 1) for d in (docs, docs.repartition(9)))
    assert (a["vocabulary"] == b["vocabulary"]).all() and np.allclose(a["weights"], b["weights"], atol=1e-3)


def test_held_out_accuracy(spark):
    got = registry.op7_language_id(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 3000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
