"""Newest row per key, and current state from a change log."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"
ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def latest_by_key(
    df: DataFrame,
    keys: Sequence[ColumnLike],
    order_by: Sequence[ColumnLike],
    tie_breakers: Sequence[ColumnLike] = (),
) -> DataFrame:
    """Keep the newest row of each key.

    Columns of `order_by`, then of `tie_breakers`, are compared from high to low with NULLs last.
    Give tie breakers that make the order total, otherwise equal rows win at random.

    Spark plans a group limit before the shuffle, so each map task sends at most one row per key:
    a key that holds a third of the table costs one row per task, not one huge sort.
    """
    newest_first = [_col(c).desc_nulls_last() for c in (*order_by, *tie_breakers)]
    window = Window.partitionBy(*[_col(k) for k in keys]).orderBy(*newest_first)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def not_blank(*columns: str) -> Column:
    """True where every column holds a non-empty value; used to drop tombstone rows."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull() & (F.col(name) != "")
    return condition


def apply_changes(
    log: DataFrame,
    keys: Sequence[ColumnLike],
    order_by: Sequence[ColumnLike],
    tie_breakers: Sequence[ColumnLike] = (),
    *,
    op: ColumnLike = "op",
    deletes: Literal["keep_last", "remove", "tombstone"] = "keep_last",
) -> DataFrame:
    """Current state of a change log.

    keep_last: delete events are left out before the newest row is chosen, so a deleted key keeps
        its last image. A NULL op is left out as well.
    remove: the newest event decides; keys whose newest event is a delete disappear.
    tombstone: as `remove`, but the delete rows stay. Store this form when batches are folded one
        after another: without the delete, an older late update would bring the key back.
    """
    operation = _col(op)
    if deletes == "keep_last":
        return latest_by_key(log.where(operation != "d"), keys, order_by, tie_breakers)
    newest = latest_by_key(log.where(operation.isNotNull()), keys, order_by, tie_breakers)
    return newest if deletes == "tombstone" else newest.where(operation != "d")
