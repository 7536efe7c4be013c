"""The corpus pipeline: documents in, token ids of a clean, deduplicated, mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet, into a new folder of the shared checkpoint folder, and read again as the next stage's docs. run() leaves
these folders, as its result is read from the last of them; remove ``corpus-*`` when the result is stored.
Every stage but the last returns the columns of documents. Nulls, empty and repeated rows are handled as the
operators say: documents without text get the share of good ones as their score
and, if that keeps them, are one group of duplicates, hold no secret and have no words, so the mix leaves them out.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dunning.llm import line_crf, mixing, piece_bpe, secrets, simhash
from dunning.llm.common import checkpoint_folder, positional, read_table
from dunning.llm.registry import quality_model, tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = line_crf.with_score(docs, quality_model(spark, docs, sf_dir))
    kept = positional(scored)  # the score is the last column, whatever the others are called
    return kept.where(F.col(kept.columns[-1]) >= line_crf.THRESHOLD).drop(kept.columns[-1]).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    doc_id, sources, text = F.col("doc_id"), F.array("source"), F.col("text")
    mix = mixing.plan_mix(docs, doc_id, sources, mixing.word_count(text))
    return mixing.mixed(docs, mix, doc_id, sources, text)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with seeded merge-dropout; each pass over a document draws anew.

    The mix repeats a document's row at most ``mixing.MAX_PASSES`` times; equal rows are numbered here.
    """
    alike = Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy(F.lit(0))
    passes = docs.select("doc_id", "source", "text").withColumn("pass", F.row_number().over(alike))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "pass")
    made = piece_bpe.with_ids(passes, tokenizer_file("piece_bpe_32k.model"), key=key)
    return made.select("doc_id", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "lossless")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Training, fingerprints and segmentation are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    folder = posixpath.join(checkpoint_folder(spark), f"corpus-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}")
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
