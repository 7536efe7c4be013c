from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunning.llm import registry, word_bpe
from dunning.llm.hashing import Lookup

FILE = registry.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(FILE.decode())


@pytest.fixture(scope="module")
def counter():
    return word_bpe.Counter(word_bpe.WordBpe(FILE), 1000)


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64))
    table = Lookup(keys, np.arange(len(keys)), -1)
    assert (table[keys] == np.arange(len(keys))).all()
    assert (table[np.setdiff1d(rng.integers(1, 1 << 62, 5000).astype(np.uint64), keys)] == -1).all()
    assert (Lookup(keys[:0], np.zeros(0, int), -1)[keys] == -1).all()


SPECIAL = ["", " ", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|endoftext", "IT'S we'Re ''s", "ΑΣ ΣΑΣ İI ı ſ K Å", "Ⅷ ½ ² ٣", "e\u0301 \u0301 \u1100\u1161", "a\x1cb\x85c\u2028d\u180ee", "🙂‍↕️ 👨‍👩‍👧", "\0\x01", "aaaa" * 500, "!" * 999, "漢字かな交じり文", "\ufeffx\ufffd"]


def test_counts_are_the_librarys(counter, library):
    rng = random.Random(5)
    ranges = [(32, 127), (0xA0, 0x250), (0x370, 0x600), (0x900, 0xE00), (0x2000, 0x2100), (0x3040, 0x3100), (0x4E00, 0x9000), (0x1F300, 0x1F700)]
    texts = SPECIAL + ["".join(chr(rng.randrange(*rng.choice(ranges[: rng.randint(1, 8)]))) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == expected
    assert [counter.counts([t])[0] for t in texts] == expected  # whatever is remembered


def test_every_code_point_is_split_like_the_library(counter, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 64):
        text = " ".join(f"a{chr(c)}b" for c in points[start : start + 64])
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        assert [stop - begin for _, (begin, stop) in pieces] == [len(w) for w in counter.bpe.words(text)[0]], hex(points[start])


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registry.op5_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for r, e in zip(docs, library.encode_batch([r.text for r in docs], add_special_tokens=False)):
        assert got[r.doc_id].n_tokens == len(e.ids) and got[r.doc_id].n_bytes == len(r.text.encode())
        assert got[r.doc_id].over_limit == (len(e.ids) > 2048)


def test_edges(spark, make_docs, stored):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "one two"), (3, "one two"), (4, "word " * 50000)]
    docs = make_docs(rows).withColumn("n_tokens", F.lit("x")).withColumn("c0", F.lit(1))
    got = registry.op5_token_counts(spark, stored(documents=docs)).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 0, False), (0, 0, False), (7, 2, False), (7, 2, False), (7, 2, False), (250000, 50000, True)]
    assert registry.op5_token_counts(spark, stored(documents=make_docs([]))).count() == 0
