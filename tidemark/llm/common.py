"""What several operators share: normalisation, scratch tables, memos, and batch helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch are handled in slices of at most this many characters, so that texts bound the memory.
SLICE_CHARS = 4_000_000


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; null becomes empty. Pure ASCII takes the fast path."""
    text = F.coalesce(column, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later stages start from it, whatever executor is lost."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folds(spark_key: str, modulus: int, left_out: int) -> Column:
    """True for rows whose crc32 of the key as text leaves the remainder `left_out`. A null key never does."""
    return F.coalesce(F.crc32(F.col(spark_key).cast("string").cast("binary")) % modulus == left_out, F.lit(False))


def fresh(name: str, df: DataFrame) -> str:
    """The name, with as many underscores before it as make it none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Longer words are not remembered: texts without spaces are words of any length.
LONG_WORD = 64


class Memo(dict):
    """A dictionary that computes missing values, and starts again when it holds `limit` of them.

    Values of keys above LONG_WORD are not kept, so that the limit bounds bytes, too.
    """

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(key) > LONG_WORD:
            return self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_CHARS):
    """(batch slice, its texts with null as ""), each of at most `limit` bytes unless one text is longer."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        bounds = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit, prepend=0))
        for start, end in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
            if end > start:
                part = batch.slice(start, end - start)
                yield part, [t or "" for t in part.column(at).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
