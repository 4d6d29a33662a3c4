"""Quality gates, file and table profiles, freshness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A quality check failed; nothing may be published."""


def quality_metrics(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: `row_count` and one boolean per check, from a single pass over the data.

    A check is an aggregate condition such as `F.count_if(F.col("ticker").isNull()) == 0`.
    """
    return df.agg(F.count(F.lit(1)).alias("row_count"), *[check.alias(name) for name, check in checks.items()])


def quality_gate(df: DataFrame, table: str, checks: Mapping[str, Column]) -> dict:
    """Evaluate all checks in one job and raise on the first that does not hold."""
    metrics = quality_metrics(df, checks).first().asDict()
    for name in checks:
        if not metrics[name]:
            raise QualityError(f"{table}: {name} (row_count={metrics['row_count']})")
    return metrics


class ObservedGate:
    """Checks that are evaluated while rows are written: no second scan, and nothing is published before they hold."""

    def __init__(self, table: str, checks: Mapping[str, Column]):
        self.table, self.checks, self.metrics = table, dict(checks), {}

    def watch(self, rows: DataFrame) -> DataFrame:
        """The rows; the job that writes them also computes the metrics."""
        self._seen = Observation()
        return rows.observe(self._seen, F.count(F.lit(1)).alias("row_count"), *[c.alias(n) for n, c in self.checks.items()])

    def check(self) -> dict:
        """After the write: the metrics, or an error for the first check that does not hold."""
        self.metrics = dict(self._seen.get)
        for name in self.checks:
            if not self.metrics[name]:
                raise QualityError(f"{self.table}: {name} (row_count={self.metrics['row_count']})")
        return self.metrics


def no_nulls(column: str) -> dict[str, Column]:
    return {f"no null {column}": F.count_if(F.col(column).isNull()) == 0}


def not_empty() -> dict[str, Column]:
    return {"row_count > 0": F.count(F.lit(1)) > 0}


def file_profile(df: DataFrame, key: str, event_time: str) -> DataFrame:
    """Per input file: rows, distinct keys, oldest and newest event, NULL keys.

    `df` must come straight from a file source.
    """
    per_file = df.withColumn("file_name", F.col("_metadata.file_name")).groupBy("file_name")
    return per_file.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(key).alias("unique_keys"),
        F.min(event_time).alias("earliest_event"),
        F.max(event_time).alias("latest_event"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table. Counts of Parquet tables come from the file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
        for name, df in tables.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def freshness(ledgers: Mapping[str, DataFrame], now: Column) -> DataFrame:
    """Newest commit of each table and how many seconds it lies back at `now`."""
    newest = None
    for name, ledger in ledgers.items():
        row = ledger.agg(F.max("committed_at").alias("last_commit")).select(
            F.lit(name).alias("table_name"), "last_commit"
        )
        newest = row if newest is None else newest.unionByName(row)
    lag = F.unix_micros(now.cast("timestamp")) - F.unix_micros("last_commit")
    return newest.withColumn("lag_seconds", F.floor(lag / F.lit(1_000_000)).cast("bigint"))
