"""Queries of this subpackage, over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.llm import divergence, forest, html_layout, line_crf, line_dedup, mixing, piece_bpe, prefix_trie, secrets, simhash, sketch, string_kernel, word_bpe
from dunning.llm.common import narrow, read_table, remainder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> bytes:
    """Bytes of a public tokenizer's file, read on the driver and sent to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")


def op1_ann_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(read_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Learned from the labelled documents whose remainder is not 0."""
    return line_crf.train(docs, read_table(spark, sf_dir, "labels"), learn=remainder(F.col("doc_id"), 5) != 0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = line_crf.with_score(docs, quality_model(spark, docs, sf_dir))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def op4_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    made = piece_bpe.with_ids(_documents(spark, sf_dir), model, key=F.col("doc_id"))
    return made.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "lossless")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_bpe.with_tokens(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > word_bpe.LIMIT).alias("over_limit"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(read_table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    mix = mixing.plan_mix(docs, F.col("doc_id"), F.array("source"), mixing.word_count(F.col("text")))
    rows = mixing.taken(mix.rows, mix, "pattern", "key", F.col("size") > 0)
    rows = rows.withColumn("source", F.col("pattern")[0])
    by_source = mixing.sized(mix.sources.withColumnRenamed("source", "name"), mix.patterns)  # here each source is one pattern
    joined = rows.join(by_source, F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('6:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (
  SELECT *, sum(size) OVER () AS total, sum(w) OVER () AS w_all,
         coalesce(sum(3 * size) OVER before, 0) AS full_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM w WINDOW before AS (ORDER BY size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - full_before) * w > 3 * size * (w_all - w_before) AS capped FROM o),
t AS (
  SELECT source, size AS source_size,
         CASE WHEN capped THEN (3 * size)::DOUBLE
              ELSE ((total - coalesce(sum(3 * size) FILTER (capped) OVER (), 0)) * w)::DOUBLE
                   / (w_all - coalesce(sum(w) FILTER (capped) OVER (), 0))::DOUBLE END AS target
  FROM c),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS part
  FROM t),
k AS (
  SELECT source, k, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM (SELECT source, k, sum(size) AS size FROM d GROUP BY source, k))
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN p.part > 0 AND k.middle <= p.part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
       JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.k = k.k
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = string_kernel.train(documents, learn=remainder(F.col("doc_id"), 3) != 1)
    found = string_kernel.with_language(_documents(spark, sf_dir), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketch.edits(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        sketch.as_text(F.col("kept")).alias("fingerprint"),
        sketch.as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        sketch.text_likeness(F.col("text"), F.col("edited"), F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        sketch.text_likeness(F.col("text"), F.col("next_text"), F.col("kept"), F.col("next_kept")).alias("near_next"),
    )


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = narrow(read_table(spark, sf_dir, "pages"), page_id="page_id", html="html")
    return html_layout.with_visible_text(pages).select("page_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH RECURSIVE x AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0::BIGINT AS i, 4294967295::BIGINT AS crc FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, s, i + 1,
         CASE WHEN i % 9 = 0 THEN xor(crc, ascii(substr(s, i // 9 + 1, 1))::BIGINT) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END
  FROM x WHERE i < 9 * length(s)),
h AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 9 AS h FROM x WHERE i = 9 * length(s)),
t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (
  SELECT t.conv_id, CASE WHEN t.conv_id % 5 = 0 THEN t.turns
                         ELSE list_concat(coalesce(b.turns, [])[1:h.h], t.turns[h.h + 1:]) END AS turns
  FROM t JOIN h ON t.conv_id = h.conv_id LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 5),
u AS (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r),
p AS (SELECT conv_id, d, turns[1:d] AS node, turns[1:d - 1] AS parent, len(turns) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].t) END AS bytes FROM u),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS members
  FROM p GROUP BY node, d),
k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY parent, d),
s AS (
  SELECT q.node, q.d, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM n LEFT JOIN k ON n.node = k.node AND n.d = k.d JOIN p q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY q.node, q.d)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.members) AS ends_sha256
FROM n LEFT JOIN k ON n.node = k.node AND n.d = k.d JOIN s ON n.node = s.node AND n.d = s.d
       LEFT JOIN n m ON n.d > 0 AND n.parent = m.node AND m.d = n.d - 1
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.with_bitmaps(read_table(spark, sf_dir, "documents"), carry_text=True)
    kept = F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep")), 256)
    return made.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), kept.alias("kept_sha256"))


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last_doc AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
o AS (
  SELECT id, lang, source, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM gn GROUP BY lang),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS p
  FROM gn JOIN k ON gn.lang = k.lang JOIN v ON gn.lang = v.lang
          LEFT JOIN c ON gn.lang = c.lang AND gn.source = c.source AND k.term = c.term),
q AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(ln.n) + 5 * any_value(v.v)) AS q
  FROM c JOIN ln ON c.lang = ln.lang JOIN v ON c.lang = v.lang GROUP BY c.lang, c.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ann_prefix_forest,
        op2_simhash_near_dedup,
        op3_quality_classifier,
        op4_sentencepiece_dropout,
        op5_token_counts,
        op6_source_mixing,
        op7_language_id,
        op8_secret_scan,
        op9_scaled_sketch,
        op10_html_layout,
        op11_prefix_trie,
        op12_line_dedup,
        op13_source_divergence,
    )
}
ORACLES: dict[str, str] = {"op6_source_mixing": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
