from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dunning.llm import piece_bpe, registry

MODEL = registry.tokenizer_file("piece_bpe_32k.model")
PIECES = piece_bpe.Pieces(MODEL)
AGENDAS = piece_bpe.Agendas(PIECES)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_without_dropout_ids_are_the_librarys(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a", "a  b ", "\n\n\tx", "naïve façade", "漢字かな🙂", "1234567890", "..!!", "x" * 3000, "²m² m²."]
    for text in texts:
        assert PIECES.encode(text) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.sampled_from([0.0, 0.1, 0.7, 1.0]), st.integers(0, 5))
def test_decoding_gives_the_text(text, rate, key):
    ids = PIECES.encode(text, rate, key)
    assert PIECES.decode(ids) == text
    assert ids == PIECES.encode(text, rate, key)


@settings(max_examples=200, deadline=None)
@given(st.text("▁ a\n.é", max_size=12))
def test_meta_symbols_in_the_text(text):
    assert PIECES.decode(PIECES.encode(text, 0.3, 1)) == text


def test_dropout_skips_merges():
    text = "the quick brown fox jumps over the lazy dog " * 20
    plain = PIECES.encode(text)
    drawn = {tuple(PIECES.encode(text, 0.3, k)) for k in range(6)}
    assert len(drawn) == 6 and all(len(d) > len(plain) for d in drawn)
    assert all(len(PIECES.pieces[i]) == 1 or PIECES.pieces[i].startswith("<0x") for i in PIECES.encode(text, 1.0, 1))
    skipped = sum(len(PIECES.encode(text, 0.3, k)) for k in range(50)) / 50
    assert skipped > sum(len(PIECES.encode(text, 0.05, k)) for k in range(50)) / 50 > len(plain)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghinorst▁é.", min_size=1, max_size=90), st.sampled_from([0.0, 0.1, 0.5]), st.integers(0, 9))
def test_both_agendas_merge_alike(chunk, rate, salt):
    limit = int(rate * (1 << 64))
    assert PIECES._short(chunk, limit, salt * 0x123456789ABCDEF) == PIECES._long(chunk, limit, salt * 0x123456789ABCDEF)


def test_memory_forgets_without_changing_ids():
    rng = random.Random(0)
    chunks = ["▁" + "".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 8))) for _ in range(2000)] + ["x" * 100, None]
    small = piece_bpe.Memory(PIECES, 0.2, 5, 10)
    large = piece_bpe.Memory(PIECES, 0.2, 5, 10**6)
    for c in chunks * 2:
        assert small[c] == large[c]
    assert len(small) + len(small.old) <= 20


def test_frames(spark, make_docs):
    rows = [(1, "one two"), (2, None), (3, ""), (None, "one two"), (1, "one two"), (4, "long word " * 20000), (5, "▁ meta\r\n")]
    docs = make_docs(rows).withColumn("ids2", F.lit(1)).withColumn("variant", F.lit("v"))
    made = piece_bpe.with_ids(docs, MODEL, key=F.col("doc_id"), dropout=0.3)
    got = made.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].ids is None and by[2].lossless is None and by[3].ids == [] and by[3].lossless
    assert all(r.lossless for r in got if r.text is not None)
    assert [r.ids for r in got if r.doc_id == 1][0] == [r.ids for r in got if r.doc_id == 1][1]
    back = piece_bpe.with_text(made, MODEL, out="back").select("text", "back").collect()
    assert all(r.text == r.back for r in back)
    again = piece_bpe.with_ids(docs.repartition(5), MODEL, key=F.col("doc_id"), dropout=0.3)
    assert sorted(map(str, (r.ids for r in again.collect()))) == sorted(map(str, (r.ids for r in got)))
    assert piece_bpe.with_ids(make_docs([]), MODEL).count() == 0


def test_query_round_trip(spark):
    got = registry.op4_sentencepiece_dropout(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.where("NOT lossless OR lossless IS NULL OR n_ids <> size(ids)").count() == 0


def test_states_draw_as_the_plain_agenda():
    rng = random.Random(1)
    chunks = ["▁" + "".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 12))) for _ in range(300)] * 5 + ["x" * 100, None, "▁" + "the" * 40]
    for rate in (0.1, 0.6, 1.0):
        keys = np.array([rng.getrandbits(64) for _ in chunks], np.uint64)
        places = np.arange(len(chunks), dtype=np.uint64)
        expected = [[PIECES.bytes[b] for b in "▁".encode()] if c is None else PIECES.drawn(c, int(rate * (1 << 64)), int(s)) for c, s in zip(chunks, piece_bpe.salts(keys, places))]
        for room in (3, 10**6):
            states = piece_bpe.States(PIECES, rate, room)
            for _ in range(2):
                ids, sizes = states.encode(chunks, keys, places)
                assert ids.tolist() == [i for x in expected for i in x] and sizes.tolist() == [len(x) for x in expected]


def test_occurrences_and_documents_draw_apart(spark, make_docs):
    text = " ".join(["nation"] * 400)
    got = piece_bpe.with_ids(make_docs([(i, text) for i in range(40)] + [(None, text), (None, text + " x")]), MODEL, key=F.col("doc_id")).collect()
    assert all(r.lossless for r in got) and len({tuple(r.ids) for r in got}) == len(got)
    n, (_, candidates) = 40000, PIECES.trail("▁nation", frozenset(), 0)
    keys, places = np.full(n, 7, np.uint64), np.arange(n, dtype=np.uint64)
    ids, sizes = piece_bpe.States(PIECES, 0.1, 1000).encode(["▁nation"] * n, keys, places)
    assert len({tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])}) > 5
    hashes = (np.array(candidates, np.uint64)[:, None] ^ piece_bpe.salts(keys, places)) * np.uint64(piece_bpe.MIX[1])
    skipped = hashes < np.uint64(int(0.1 * (1 << 64)))
    assert np.all(abs(skipped.mean(axis=1) - 0.1) < 0.01) and abs((~skipped).all(axis=0).mean() - 0.9 ** len(candidates)) < 0.02


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abeinorst▁é.漢🙂\x01", min_size=1, max_size=64), max_size=30), st.sampled_from([0.0, 0.1, 0.6, 1.0]), st.integers(0, 9))
def test_agendas_side_by_side_are_the_single_ones(chunks, rate, seed):
    limit, rng = int(rate * (1 << 64)), random.Random(seed)
    salts = np.array([rng.getrandbits(64) for _ in chunks], np.uint64)
    ids, sizes, places, candidates = AGENDAS.run(chunks, limit, salts)
    cut = lambda flat, n: [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] if len(chunks) else []
    assert cut(ids, sizes) == [PIECES.drawn(c, limit, int(s)) for c, s in zip(chunks, salts)]
    if not limit:
        assert cut(places, candidates) == [PIECES.trail(c, frozenset(), 0)[1] for c in chunks]


def test_very_long_texts_are_held_one_at_a_time():
    import pyarrow as pa

    from dunning.llm.common import SLICE_BYTES, slices

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (SLICE_BYTES // 2 + 1)] * 7 + ["y"] * 9), pa.array([[1] * (SLICE_BYTES // 2 + 1)] * 3 + [[]] * 13)], names=["text", "ids"])
    assert [s.num_rows for s in slices(batch, 0)] == [1] * 6 + [10]
    assert [s.num_rows for s in slices(batch, 1)] == [1, 1, 14]
