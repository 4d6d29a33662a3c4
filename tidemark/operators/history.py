"""Comparing versions of a table, and its state at many moments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.versioned import VersionedTable


def compare_counts(table: VersionedTable) -> DataFrame:
    """Row count of the current and the previous version."""
    versions = {"current": table.current(), "previous": table.previous()}
    counts = [
        table.read_as_of(version)
        .agg(F.count(F.lit(1)).alias("record_count"))
        .select(F.lit(name).alias("version"), "record_count")
        for name, version in versions.items()
        if version is not None
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def row_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed between two versions of a keyed table.

    Only the key and a 64-bit digest of the other columns are shuffled. Both sides are unique by key.
    """
    names = [c for c in after.columns if c in before.columns]
    values = [c for c in names if c not in keys]

    def digest(df: DataFrame, alias: str) -> DataFrame:
        # The hash passes over NULLs, so a value moving to the neighbouring column needs the flags.
        parts = [part for v in values for part in (F.col(v), F.col(v).isNull())]
        return df.select(*keys, F.xxhash64(*parts).alias(alias))

    joined = digest(before, "old").join(digest(after, "new"), list(keys), "full_outer")
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "changed")
    )
    return joined.select(*keys, kind.alias("change")).where(F.col("change").isNotNull())


VALID_FROM, VALID_TO = "valid_from", "valid_to"


def validity(
    log: DataFrame, keys: Sequence[str], at: str, tie_breakers: Sequence[str | Column] = (), *, deleted: Column | None = None
) -> DataFrame:
    """The images of a change log with the time in which each was the current one: from `valid_from` until before `valid_to`.

    A later image of the key ends an interval, and so does a row for which `deleted` holds; such rows are no images of their
    own. The last interval is open (`valid_to` NULL). Of images of one moment only the last by `tie_breakers` is ever current. Rows without
    a time are left out. One sort by key and time serves all moments; nothing is rebuilt for each.
    """
    timed = log.where(F.col(at).isNotNull())
    order = Window.partitionBy(*keys).orderBy(at, *tie_breakers)
    rows = timed.withColumn(VALID_FROM, F.col(at)).withColumn(VALID_TO, F.lead(at).over(order))
    if deleted is not None:
        rows = rows.where(~F.coalesce(deleted, F.lit(False)))
    return rows.where(F.col(VALID_TO).isNull() | (F.col(VALID_FROM) < F.col(VALID_TO)))


def _valid(moment: Column) -> Column:
    return (F.col(VALID_FROM) <= moment) & (F.col(VALID_TO).isNull() | (moment < F.col(VALID_TO)))


def state_at(intervals: DataFrame, moments: Sequence[datetime], name: str = "as_of") -> DataFrame:
    """The whole state at each of a list of moments, told apart by the column `name`: one narrow pass over the intervals.

    The moments are literals; there is no join, and nothing is shuffled.
    """
    when = F.array(*[F.lit(m) for m in moments]) if moments else F.array().cast("array<timestamp>")
    return intervals.select("*", F.explode(F.filter(when, _valid)).alias(name))


def as_of_lookup(lookups: DataFrame, intervals: DataFrame, keys: Sequence[str], moment: str) -> DataFrame:
    """Each row of `lookups` with the image of its key at its `moment`; rows without one are left out.

    An equi-join by key in which the interval is checked pair by pair: each lookup meets the intervals of its own key. A key with
    very many lookups is split by adaptive execution.
    """
    held = intervals.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    same = reduce(and_, (F.col(k) == F.col(f"__{k}") for k in keys))
    return lookups.join(held, same & _valid(F.col(moment))).drop(*[f"__{k}" for k in keys])
