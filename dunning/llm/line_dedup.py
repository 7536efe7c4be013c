"""Line dedup: boilerplate lines lose all copies but those of one document, in Spark functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
least ``KEY_CHARS`` code points that stand in at least ``KEY_DOCS`` documents lose all
their lines except those of the largest document id that holds them.

Key hashes (two independent 64-bit ones) are range-partitioned with a secondary sort by
document, largest first, and position; one pass over a partition sees a key's first
document first, then the others. Only positions of lines to drop leave it, and every
document gets its keep bitmap in compressed form: the runs of lines that stay, as (start,
length). No text takes part before a bitmap is applied to it.

A key that holds more than a thousandth of all lines, of which there can be at most
``HOT_KEYS``, is not sorted at all: map-side aggregation gives its number of documents and its
largest one, and these few rows are broadcast.

Nulls and edges: a null or empty text is one empty line; a null document id is one more
document, below all others; rows that share an id are one document when documents are
counted, but each row has its own bitmap; equal rows get equal bitmaps; very long texts are
split whole; an empty table gives an empty one. Rows are told apart by id and a 64-bit
hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.llm.common import FIRST, checkpointed, let, narrow

KEY_CHARS, KEY_DOCS = 40, 5
#: Most keys that may be hot (the bound of the broadcast), and least lines of a hot one.
HOT_KEYS, HOT_LINES = 1000, 1000
#: Key hashes are counted in so many bins first: only keys of crowded bins can be hot.
BINS = 4096
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and as ``x_doc``, ``x_row`` what tells the rows apart."""
    docs = narrow(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.select("*", F.coalesce("doc_id", F.lit(FIRST)).alias("x_doc"), F.xxhash64("text").alias("x_row"))


def key_lines(rows: DataFrame) -> DataFrame:
    """h1, h2, x_doc, x_row, pos of every line whose key is long enough."""
    lines = rows.select("x_doc", "x_row", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER)
    long_enough = lines.where(F.char_length("line") >= KEY_CHARS).withColumn("key", key).where(F.char_length("key") >= KEY_CHARS)
    return long_enough.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "x_doc", "x_row", "pos")


def hot_keys(lines: DataFrame) -> DataFrame | None:
    """n_docs and last_doc of the at most ``HOT_KEYS`` keys with more than a thousandth of all lines; None if no bin is so full."""
    bins = lines.groupBy(F.pmod("h1", F.lit(BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit = max(sum(b.n for b in bins) // HOT_KEYS, HOT_LINES)
    crowded = [b.bin for b in bins if b.n > limit]
    if not crowded:
        return None
    inside = lines.where(F.pmod("h1", F.lit(BINS)).isin(crowded))
    per_doc = inside.groupBy(*KEY, "x_doc").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_doc.groupBy(*KEY).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.max("x_doc").alias("last_doc"))
    return per_key.where(F.col("n") > limit).drop("n")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """x_doc, x_row, pos of the lines that go."""
    falls = (F.col("n_docs") >= KEY_DOCS) & (F.col("x_doc") < F.col("last_doc"))
    hot, rest, found = hot_keys(lines), lines, []
    if hot is not None:
        rest = lines.join(F.broadcast(hot), KEY, "left_anti")
        found = [lines.join(F.broadcast(hot.where(F.col("n_docs") >= KEY_DOCS)), KEY)]
    key = Window.partitionBy(*KEY)
    down = key.orderBy(F.col("x_doc").desc(), "pos")
    opens = ~F.lag("x_doc").over(down).eqNullSafe(F.col("x_doc"))  # a document's first line with this key
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    streamed = rest.repartitionByRange(*KEY).withColumns({"last_doc": F.first("x_doc").over(whole), "n": F.count(F.lit(1)).over(whole), "opens": opens.cast("int")})
    many = streamed.where(F.col("n") >= KEY_DOCS)  # most keys have a line or two and are done here
    found.append(many.withColumn("n_docs", F.sum("opens").over(key)).drop("n", "opens"))
    gone = [f.where(falls).select("x_doc", "x_row", "pos") for f in found]
    return gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])


def runs(n_lines: Column, dropped: Column) -> Column:
    """The keep bitmap: runs (start, length) of lines that stay, from the sorted positions that go."""

    def run(at: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1) + 1)
        stop = F.when(i == F.size(at), n_lines).otherwise(F.get(at, i))
        return F.struct(start.alias("start"), (stop - start).alias("length"))

    every = let(dropped, lambda at: F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: run(at, i)))
    return F.filter(every, lambda r: r["length"] > 0)


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines its bitmap leaves out."""
    return let(split_lines(text), lambda lines: F.array_join(F.transform(keep, lambda r: F.array_join(F.slice(lines, r["start"] + 1, r["length"]), "\n")), "\n"))


def with_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``keep`` of every row, and its text on request.

    The documents meet the positions last, between two exchanges, so a row repeated very
    often is split at run time.
    """
    rows = _rows(df, doc_id, text)
    gone = dropped_lines(checkpointed(key_lines(rows))).groupBy("x_doc", "x_row").agg(F.sort_array(F.collect_set("pos")).alias("x_gone"))
    n_lines = F.size(split_lines(F.col("text")))
    full = rows.select("doc_id", *(["text"] if carry_text else []), "x_doc", "x_row", n_lines.alias("n_lines"))
    met = full.join(gone, ["x_doc", "x_row"], "left").withColumn("x_gone", F.coalesce("x_gone", F.array().cast("array<int>")))
    out = met.select("*", F.size("x_gone").alias("n_dropped"), runs(F.col("n_lines"), F.col("x_gone")).alias("keep"))
    return out.drop("x_doc", "x_row", "x_gone")
