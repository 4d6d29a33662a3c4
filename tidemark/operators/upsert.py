"""Merging an increment into a current-state table, as a new DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedup import latest_by_key

_FRESH = "__fresh"


@dataclass(frozen=True)
class MergeSpec:
    """Column rules of a merge: target column -> source column.

    `update` lists what a match refreshes (everything else keeps the stored value), `insert` what a
    new key gets (everything else is NULL). With `order`, columns that both sides carry, a match
    changes nothing when the incoming row is older than the stored one; NULLs count as oldest.
    """

    keys: tuple[str, ...]
    update: Mapping[str, str] = field(default_factory=dict)
    insert: Mapping[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()


def _merged_columns(target: T.StructType, spec: MergeSpec) -> list[Column]:
    """Target columns out of the stored row image `t` and the incoming one `s`; either may be NULL."""
    has_target, updating = F.col("t").isNotNull(), F.col("s").isNotNull()
    if spec.order:
        incoming, stored = (F.struct(*[F.col(f"{side}.{c}") for c in spec.order]) for side in ("s", "t"))
        updating = updating & (incoming >= stored)

    def pick(field: T.StructField) -> Column:
        name = field.name
        old = F.col(f"t.{name}")
        inserted = F.col(f"s.{spec.insert[name]}") if name in spec.insert else F.lit(None)
        updated = F.col(f"s.{spec.update[name]}") if name in spec.update else old
        return (
            F.when(has_target & updating, updated.cast(field.dataType))
            .when(has_target, old)
            .otherwise(inserted.cast(field.dataType))
        ).alias(name)

    return [pick(field) for field in target.fields]


def merge_upsert(target: DataFrame, source: DataFrame, spec: MergeSpec) -> DataFrame:
    """MERGE ... WHEN MATCHED UPDATE ... WHEN NOT MATCHED INSERT for tables without MERGE support.

    The source must be unique by key. One full outer join on the key; keys are unique on both sides,
    so no partition of it can be skewed.
    """
    stored = target.select(F.struct(*target.columns).alias("t"), *[F.col(k).alias(f"tk_{k}") for k in spec.keys])
    incoming = source.select(F.struct(*source.columns).alias("s"), *[F.col(k).alias(f"sk_{k}") for k in spec.keys])
    on = [F.col(f"tk_{k}") == F.col(f"sk_{k}") for k in spec.keys]
    return stored.join(incoming, on, "full_outer").select(*_merged_columns(target.schema, spec))


def merge_union(both: DataFrame, target: T.StructType, spec: MergeSpec, within: Sequence[str] = ()) -> DataFrame:
    """The same merge over `union_rows`, for rows already clustered by the `within` columns.

    Grouping by those columns and the key needs no further shuffle.
    """
    names = [c for c in both.columns if c != _FRESH and c not in within]
    image = F.struct(*names)
    pairs = both.groupBy(*within, *spec.keys).agg(
        F.first(F.when(F.col(_FRESH) == 0, image), ignorenulls=True).alias("t"),
        F.first(F.when(F.col(_FRESH) == 1, image), ignorenulls=True).alias("s"),
    )
    return pairs.select(*within, *_merged_columns(target, spec))


def union_rows(target: DataFrame, increment: DataFrame) -> DataFrame:
    """Stored rows and increment in one DataFrame, marked so that the increment wins ties."""
    return target.withColumn(_FRESH, F.lit(0)).unionByName(
        increment.withColumn(_FRESH, F.lit(1)), allowMissingColumns=True
    )


def newest_of_union(
    both: DataFrame, keys: Sequence[str], order_by: Sequence[str], tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """Newest row per key of `union_rows`."""
    return latest_by_key(both, keys, order_by, (*tie_breakers, _FRESH)).drop(_FRESH)


def union_upsert(
    target: DataFrame,
    increment: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Existing rows plus increment, newest per key. On equal order the increment wins.

    Late rows lose against newer stored ones and repeated deliveries change nothing.
    """
    return newest_of_union(union_rows(target, increment), keys, order_by, tie_breakers)
