"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: the number of
different character n-grams (1 to ``ORDERS`` letters, word edges included) that both hold,
over the geometric mean of the numbers each holds; n-grams that no landmark holds
are left out. Landmarks are a bounded, stratified, seeded sample of the training
documents. With K the kernel between landmarks, a text's features are its kernel
values to the landmarks times K to the power -1/2; one ridge regression per
language (one against the rest) is solved on them. Everything after the n-grams is
matrix products over batches of texts.

Texts are taken letter by letter in lower case; whatever is no letter separates
words. Only the sample's n-grams and kernel values come to the driver.

Nulls and edges: a null text, an empty one or one without a letter gets ``und`` with
score 0; a text none of whose n-grams is known gets the commonest language of the
sample with score 0, as does every text with letters if there is one language only (score by its own
regression); without any labelled document every text gets ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.common import add_columns, checkpointed, hash_order, likely_first, narrow
from dunning.llm.hashing import Lookup

ORDERS = 3
#: Training documents and landmarks per language, and training documents at most.
DOCS_PER_LANG, LANDMARKS_PER_LANG, SAMPLE_DOCS = 800, 24, 20_000
RIDGE = 1e-2
SEED = 7
UNKNOWN = "und"
#: Entries of the presence matrix made at once; bounds memory.
CELLS = 4_000_000
#: Letters whose n-grams are looked up at once; bounds memory for a very long text.
WINDOW = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to that of its lower case plus 2; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            table[c] = ord(s.lower()[0]) + 2
    return table


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with a separator (1) at both ends of a text and one between words, and the number of the text each is from."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    char = _letters()[codes]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(doc)] if len(doc) else first
    char, doc = (np.insert(a, np.r_[ends, first], b) for a, b in ((char, 0), (doc, np.r_[doc[first], doc[first]])))
    gap = char == 0
    keep = np.r_[True, ~(gap[1:] & gap[:-1] & (doc[1:] == doc[:-1]))] if len(char) else np.zeros(0, bool)
    return np.where(gap, np.uint32(1), char)[keep], doc[keep]


def grams(texts: list[str], window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed n-grams of the texts, repeats included, and the number of the text each is from; as many letters at once as ``window``."""
    char, doc = letters(texts)
    for start in range(0, len(char), window):
        part, of = char[start : start + window + ORDERS - 1].astype(np.uint64), doc[start : start + window + ORDERS - 1]
        code, firsts = part, min(window, len(part))
        yield code[:firsts], of[:firsts]
        for n in range(2, ORDERS + 1):
            code = code[:-1] << np.uint64(21) | part[n - 1 :]
            same = np.flatnonzero(of[: len(code)][:firsts] == of[n - 1 :][:firsts])
            yield code[same], of[same]


def gram_set(text: str) -> np.ndarray:
    """Different n-grams of a text, sorted."""
    found = [np.unique(code) for code, _ in grams([text])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Presence:
    """Which n-grams of a fixed vocabulary texts hold, as rows of length 1."""

    def __init__(self, vocabulary: np.ndarray):
        self.size = len(vocabulary)
        self.place = Lookup(vocabulary, np.arange(self.size), -1)

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for code, doc in grams(texts):
            at = self.place[code]
            known = np.flatnonzero(at >= 0)
            out[doc[known], at[known]] = 1
        return out / np.maximum(np.sqrt(out.sum(axis=1, keepdims=True)), 1)


def batches(texts: list[str], size: int) -> list[list[str]]:
    step = max(1, CELLS // max(size, 1))
    return [texts[i : i + step] for i in range(0, len(texts), step)]


def predict(texts: list[str | None], model: dict | None, presence: Presence | None) -> tuple[list[str], list[float]]:
    """Language and score (0 to 1) of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    real = [i for i, t in enumerate(texts) if has_letter(t)]
    if model is None or not real:
        return langs, scores
    at = 0
    for part in batches([texts[i] for i in real], presence.size):
        rows = presence.rows(part)
        value = (rows @ model["landmarks"].T) @ model["weights"]
        best = value.argmax(axis=1)
        empty = rows.max(axis=1, initial=0) == 0
        for k in range(len(part)):
            langs[real[at]] = model["default"] if empty[k] else model["langs"][best[k]]
            scores[real[at]] = 0.0 if empty[k] else float(min(max(value[k, best[k]], 0.0), 1.0))
            at += 1
    return langs, scores


def _gram_sets():
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([gram_set(t).tobytes() for t in texts.to_pylist()], pa.binary())]

    return run


def _kernel_rows(shared):
    landmarks, vocabulary = shared.value
    presence = Presence(vocabulary)

    def run(texts: pa.Array) -> list[pa.Array]:
        rows = [r.tobytes() for part in batches(texts.to_pylist(), presence.size) for r in presence.rows(part) @ landmarks.T]
        return [pa.array(rows, pa.binary())]

    return run


def train(documents: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """Model from a bounded, seeded sample (the same number per language, as far as there are) of rows with a language for which ``learn`` (over ``doc_id``) holds."""
    spark = documents.sparkSession
    docs = narrow(documents, doc_id=doc_id, text=text, lang=lang).where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    if learn is not None:
        docs = docs.where(learn)
    order = [hash_order("doc_id", SEED), F.col("doc_id")]
    sizes = docs.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("different"))  # one row per language
    near = docs.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(likely_first("doc_id", SEED, DOCS_PER_LANG, F.col("different")))
    ranked = near.select("doc_id", "lang").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rn") <= DOCS_PER_LANG)
    chosen = ranked.orderBy("rn", *order).limit(SAMPLE_DOCS).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "rn")
    sample = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))  # at most SAMPLE_DOCS rows
    sample = checkpointed(sample.select("doc_id", "lang", "text", "rn").limit(2 * SAMPLE_DOCS))
    first = add_columns(sample.where(F.col("rn") <= LANDMARKS_PER_LANG), "text", [T.StructField("grams", T.BinaryType())], _gram_sets)
    found = first.select("lang", "doc_id", "grams").collect()
    sets = [np.frombuffer(bytes(r.grams), np.uint64) for r in sorted(found, key=lambda r: (r.lang, r.doc_id, bytes(r.grams)))]
    sets = [s for s in sets if len(s)]
    if not sets:
        return None
    vocabulary = np.unique(np.concatenate(sets))
    landmarks = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        landmarks[i, np.searchsorted(vocabulary, s)] = 1
    landmarks /= np.sqrt(landmarks.sum(axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast((landmarks, vocabulary))  # bounded by the number of landmarks
    rows = add_columns(sample, "text", [T.StructField("k", T.BinaryType())], partial(_kernel_rows, shared)).select("lang", "doc_id", "k").collect()
    rows = sorted((r.lang, r.doc_id, bytes(r.k)) for r in rows)
    langs = sorted({r[0] for r in rows})
    kernel = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64)
    target = np.array([[r[0] == x for x in langs] for r in rows], np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    large = values > 1e-4 * values.max()
    root = vectors[:, large] / np.sqrt(values[large])  # K to the power -1/2, up to a rotation
    features = kernel @ root
    solved = np.linalg.solve(features.T @ features + RIDGE * len(rows) / len(sets) * np.eye(root.shape[1]), features.T @ target)
    counts = Counter(r[0] for r in rows)
    return {"langs": langs, "default": max(langs, key=lambda x: (counts[x], x)), "landmarks": landmarks, "vocabulary": vocabulary, "weights": (root @ solved).astype(np.float32)}


def _predictor(shared):
    model = shared.value
    presence = None if model is None else Presence(model["vocabulary"])

    def run(texts: pa.Array) -> list[pa.Array]:
        langs, scores = predict(texts.to_pylist(), model, presence)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return run


def with_language(df: DataFrame, model: dict | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` and its texts' predicted language and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: bounded by the sample
    return add_columns(df, text, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], partial(_predictor, shared))
