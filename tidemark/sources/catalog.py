"""Catalog tables: existence probe, create-as-select, bucketed tables, and the watermark kept as a table property."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

WATERMARK_PROPERTY = "last_processed_snapshot_id"


def table_exists(spark: SparkSession, table: str) -> bool:
    """First-run probe. Connection or permission problems raise, they do not read as 'missing'."""
    return spark.catalog.tableExists(table)


def get_watermark(spark: SparkSession, table: str) -> int | None:
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    value = properties.get(WATERMARK_PROPERTY)
    return int(value) if value is not None else None


def set_watermark(spark: SparkSession, table: str, snapshot_id: int) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{WATERMARK_PROPERTY}' = '{int(snapshot_id)}')")


def create_table_as(df: DataFrame, table: str, location: str) -> None:
    """Write a result as Parquet files at `location` and register it; an existing table is an error."""
    df.write.format("parquet").option("path", location).saveAsTable(table)


def create_bucketed(df: DataFrame, table: str, location: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write rows as a catalog table of `buckets` buckets by the keys, each one sorted file, and return it.

    Tables of equal keys and numbers of buckets are joined bucket by bucket, without a shuffle. Choose `buckets` so that one of the larger
    table is a few hundred MB.
    """
    dealt = df.repartition(buckets, *keys)  # one file a bucket: the hash is the one that bucketing takes
    dealt.write.format("parquet").option("path", location).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)
