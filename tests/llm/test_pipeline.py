from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dunning.llm import line_crf, mixing, piece_bpe, registry, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def folder(spark, make_docs, stored):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in docs]
    good = next(r for r in rows if len(r[1]) > 800 and "!!" not in r[1] and "%%%" not in r[1] and " | " not in r[1])
    rows += [(900001, good[1], "en", "src0"), (900002, good[1] + "\ntoken = 0123456789abcdef0123", "en", "src0"), (900003, None, None, None), (900004, "", "en", None), (None, good[1].upper(), None, "src1"), (900005, good[1] + " tail words", "en", "src1"), (900005, good[1] + " tail words", "en", "src1")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return stored(documents=make_docs(rows).withColumns({c: F.lit("extra") for c in ("size", "quality_score", "score", "ids", "pass", "c0")}), labels=labels)


def test_against_a_plain_version(spark, folder):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    model = registry.quality_model(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    score = line_crf.scores([None if r["text"] is None else r["text"].encode() for r in rows], model)
    kept = [r for r, s in zip(rows, score) if s >= line_crf.THRESHOLD]
    assert 0 < len(kept) < len(rows)
    prints = [simhash.fingerprint(None if r["text"] is None else r["text"].encode()) % (1 << 64) for r in kept]
    groups: list[list[int]] = []
    for i, p in enumerate(prints):
        near = [g for g in groups if any(bin(p ^ prints[j]).count("1") <= 2 for j in g)]
        groups = [g for g in groups if g not in near] + [[i, *(j for g in near for j in g)]]
    unique = [min((kept[i] for i in g), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups]
    for r in unique:
        r["text"] = secrets.redacted(r["text"], secrets.spans(r["text"]))
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in unique], "doc_id long, source string, text string")
    mix = mixing.plan_mix(docs, F.col("doc_id"), F.array("source"), mixing.word_count(F.col("text")))
    mixed = mixing.mixed(docs, mix, F.col("doc_id"), F.array("source"), F.col("text")).collect()
    pieces = piece_bpe.Pieces(registry.tokenizer_file("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.source, pieces.decode(r.ids)) for r in got) == sorted((r.doc_id, r.source, r.text) for r in mixed)
    assert all(r.lossless and r.n_ids == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_empty(spark, make_docs, stored):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, stored(documents=make_docs([]), labels=labels)).count() == 0


def test_hot_source_and_copies(spark, make_docs, stored):
    rng = random.Random(0)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(200)]
    rows += [(1000 + i, rows[0][1], "en", "hot") for i in range(150)]
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    got = corpus_pipeline.run(spark, stored(documents=make_docs(rows), labels=labels))
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert not any(i >= 1000 for i in times) and max(times.values()) <= 3


def test_passes_over_a_document_draw_apart(spark, make_docs):
    text = "international organizations considered several alternatives " * 10
    docs = make_docs([(1, text, "en", "a")] * 3 + [(None, text, "en", "a")] * 2 + [(2, "x", "en", "a")])
    got = corpus_pipeline.encode(spark, docs, SF).collect()
    pieces = piece_bpe.Pieces(registry.tokenizer_file("piece_bpe_32k.model"))
    long = [r for r in got if r.doc_id != 2]
    assert len(got) == 6 and len({tuple(r.ids) for r in long}) == 5
    assert all(pieces.decode(r.ids) == text and r.lossless for r in long)
    again = corpus_pipeline.encode(spark, docs.repartition(4), SF).collect()
    assert sorted(r.ids for r in again) == sorted(r.ids for r in got)
