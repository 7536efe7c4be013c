from __future__ import annotations

import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunning.llm import line_crf, registry

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("stretch", [1, 2, 3, 512])
def test_marginals_are_those_of_all_labelings(stretch, monkeypatch):
    monkeypatch.setattr(line_crf, "STRETCH", stretch)
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs, log_z = line_crf.Chains(doc).marginals(score, trans)
    total, expected, counts = 0.0, np.zeros(8), np.zeros((2, 2))
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)
        weights = {y: np.exp(sum(score[i] * k for i, k in zip(at, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(at))}
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            expected[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                counts[a, b] += w / z
    assert np.allclose(got, expected) and np.allclose(pairs, counts) and np.isclose(log_z, total)


def test_one_very_long_document_takes_seconds(monkeypatch):
    rng = np.random.default_rng(1)
    doc = np.r_[np.zeros(400_000, int), np.full(700, 1), np.full(3, 2)]
    score, trans = rng.normal(size=len(doc)) * 3, rng.normal(size=(2, 2))
    began = time.process_time()
    got, pairs, log_z = line_crf.Chains(doc).marginals(score, trans)
    assert time.process_time() - began < 10
    monkeypatch.setattr(line_crf, "STRETCH", 5000)  # cut elsewhere
    other = line_crf.Chains(doc).marginals(score, trans)
    assert np.allclose(got, other[0]) and np.allclose(pairs, other[1]) and np.isclose(log_z, other[2])
    assert np.isclose(pairs.sum(), len(doc) - 3)
    text = "\n".join(f"line {k} of a text, and more" for k in range(400_000)).encode()
    model = line_crf.fit(*line_crf.line_shapes([b"good line\nand more", b"$$$ !!!\n###"]), np.array([1, 0]))
    began = time.process_time()
    assert 0 <= line_crf.scores([text, b"x"], model)[0] <= 1
    assert time.process_time() - began < 30


def test_shapes_do_not_depend_on_the_batch():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab A1.!|$é \n\t") for _ in range(rng.randint(0, 60))).encode() for _ in range(50)] + [None, b"", b"\n\n", b" ", b"x"]
    whole, size, doc = line_crf.line_shapes(texts)
    for d, text in enumerate(texts):
        one, n, _ = line_crf.line_shapes([text])
        assert np.allclose(whole[doc == d], one) and np.allclose(size[doc == d], n)
        assert len(one) == sum(bool(line.strip(b" \t\n\x0b\x0c\r")) for line in (text or b"").split(b"\n"))


def test_score_does_not_depend_on_the_batch_and_weighs_by_length():
    marginal, size, doc = np.array([1.0, 0.0, 0.5]), np.array([30.0, 10.0, 7.0]), np.array([0, 0, 1])
    got = line_crf.doc_quality(marginal, size, doc, 3)
    assert np.allclose(got[:2], [0.75, 0.5]) and np.isnan(got[2])


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0)], "doc_id long, quality int")
    good, bad = "Plain words stand in a line here.\nAnd another line.", "BUY!! NOW!! $$$ ### %%%\nBUY!! NOW!!"
    docs = make_docs([(1, good), (2, bad), (2, bad), (3, None), (4, ""), (5, "\n \n"), (None, good), (6, good * 3000), (7, good)]).withColumn("score", F.lit("x")).withColumn("label", F.lit("y"))
    model = line_crf.train(docs, labels)
    got = line_crf.with_score(docs, model, out="q").collect()
    by = {(r.doc_id, r.text): r.q for r in got}
    assert len(got) == 9 and all(0 <= r.q <= 1 for r in got)
    assert by[(7, good)] > by[(2, bad)] and by[(None, good)] == by[(1, good)]
    assert by[(3, None)] == by[(4, "")] == by[(5, "\n \n")] == model["share"]
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert all(0 <= r.q <= 1 for r in line_crf.with_score(docs, line_crf.train(docs, none), out="q").collect())
    assert line_crf.with_score(make_docs([]), line_crf.train(make_docs([]), labels)).count() == 0


def test_sample_is_bounded_and_seeded(spark, make_docs):
    docs = make_docs([(i, f"line {i}\nmore") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    a, b = (line_crf.train(d, labels, sample_docs=20) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a["weights"], b["weights"]) and a["share"] == b["share"]


def test_held_out_accuracy(spark):
    got = registry.op3_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
