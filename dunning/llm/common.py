"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text handed to a kernel at once (a longer text goes alone); bounds a
#: Python worker's memory, not the work.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000
HASH_RANGE = 1 << 40
#: What a null id counts as in an order: below every id.
FIRST = -(1 << 63)
#: Times the sample that is sorted for it.
SPARE = 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Place of a column: the exact name first, else the only one that differs in case."""
    names = df.columns
    if name in names:
        return names.index(name)
    alike = [i for i, c in enumerate(names) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"column {name!r} not found once in {names}")
    return alike[0]


def positional(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ...: no name can clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, **want: str) -> DataFrame:
    """``narrow(df, doc_id="id")``: only the wanted columns, under the given new names."""
    at = {new: position(df, old) for new, old in want.items()}
    return positional(df).select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and bytes of text (or list elements) in column ``at``."""
    size = pc.list_value_length if pa.types.is_list(batch.column(at).type) else pc.binary_length
    upto = np.r_[0, np.cumsum(pc.fill_null(size(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(upto, upto[start] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], factory: Callable[[], Callable]) -> DataFrame:
    """Append columns computed from one column, batch by batch in Arrow.

    ``factory()`` runs once per task and returns a kernel taking an Arrow array and
    returning one Arrow array per new field. Every row stays, in its order; existing
    columns may have any names.
    """
    at, old = position(df, column), df.columns
    plain = positional(df)
    new = [T.StructField(f"n{i}", f.dataType, True) for i, f in enumerate(fields)]
    names = plain.columns + [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = factory()
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *kernel(part.column(at))], names=names)

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *new]))
    return out.toDF(*old, *[f.name for f in fields])


def as_bytes(values: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string array."""
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. A local session that names
    none, as in tests, gets one in its warehouse; on a cluster that is an error, as no other folder is known to be shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def hash_order(key: str, seed: int) -> Column:
    """Seeded order of keys, from 0 to below ``HASH_RANGE``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(HASH_RANGE))


def likely_first(key: str, seed: int, rows: int, different: Column) -> Column:
    """Holds for the first few times ``rows`` of ``different`` keys in hash order, and for
    all of a small number: what a sample of ``rows`` can come from, so that its
    sort does not grow with the input."""
    return hash_order(key, seed) < F.least(F.lit(1.0), F.lit(SPARE * rows) / F.greatest(different, F.lit(1))) * HASH_RANGE


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows with the smallest seeded hash of ``key``."""
    different = df.agg(F.approx_count_distinct(key)).first()[0]
    near = df.where(likely_first(key, seed, rows, F.lit(different)))
    return near.orderBy(hash_order(key, seed), F.col(key)).limit(rows)
