"""Raw to curated: filter, newest row per key, types and derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import is_buy, mid_price, parse_timestamp, spread, to_typed, to_whole
from tidemark.model import Entity
from tidemark.operators.dedup import apply_changes, latest_by_key, not_blank
from tidemark.operators.upsert import MergeSpec, merge_upsert

#: Columns that stored rows carry beside their own, so that a later increment can be compared with them: the time of the
#: event behind an entity row, and the tie breakers in their order.
EVENT_AT, TIE = "_event_at", "_tie_"


def tie_names(tie_breakers: Sequence[str]) -> list[str]:
    return [f"{TIE}{i}" for i in range(len(tie_breakers))]


def _ties(tie_breakers: Sequence[str]) -> list[Column]:
    return [F.col(t).alias(name) for t, name in zip(tie_breakers, tie_names(tie_breakers), strict=True)]


def typed_ticks(raw: DataFrame, keep: Sequence[str | Column] = ()) -> DataFrame:
    """Ticks with typed base columns, tombstones dropped, duplicates still in. Narrow."""
    return raw.where(not_blank("ticker")).select(
        "tick_id",
        "ticker",
        F.col("bid").try_cast("double").alias("bid"),
        F.col("ask").try_cast("double").alias("ask"),
        F.col("last_price").try_cast("double").alias("last_price"),
        to_whole("volume").alias("volume"),
        "instrument_id",
        parse_timestamp("timestamp").alias("tick_timestamp"),
        *keep,
    )


def derive_tick_columns(ticks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return ticks.select(
        "tick_id",
        "ticker",
        "bid",
        "ask",
        "last_price",
        "volume",
        "instrument_id",
        "tick_timestamp",
        spread(F.col("bid"), F.col("ask")).alias("spread"),
        mid_price(F.col("bid"), F.col("ask")).alias("mid_price"),
        F.date_trunc("hour", "tick_timestamp").alias("tick_hour"),
        *keep,
    )


def curate_market_ticks(raw: DataFrame, tie_breakers: Sequence[str] = (), *, keep_ties: bool = False) -> DataFrame:
    """One typed row per tick id, the newest. `tie_breakers` are raw columns such as an offset;
    `keep_ties` keeps them under `tie_names`, for tables that increments are folded into.

    The newest row is chosen by the typed time, not its text: texts of different offset or precision
    do not sort by time. Rows are typed before the shuffle, which makes them smaller, and the
    derived columns are computed after it.
    """
    ties = tie_names(tie_breakers)
    newest = latest_by_key(typed_ticks(raw, _ties(tie_breakers)), ["tick_id"], ["tick_timestamp"], ties)
    return derive_tick_columns(newest, ties if keep_ties else ())


def curate_order_events(raw: DataFrame, tie_breakers: Sequence[str] = (), *, keep_ties: bool = False) -> DataFrame:
    """One typed row per order, from the flat change log; deletes are skipped (see `apply_changes`).

    Without a `_cdc` column the input counts as plain rows. `keep_ties` is as in `curate_market_ticks`.
    """
    rows = raw.where(F.col("order_id").isNotNull()).withColumn("__at", parse_timestamp("updated_at"))
    if "_cdc" in raw.columns:
        newest = apply_changes(rows, ["order_id"], ["__at"], tie_breakers, op="_cdc.op")
    else:
        newest = latest_by_key(rows, ["order_id"], ["__at"], tie_breakers)
    created = parse_timestamp("created_at")
    return newest.select(
        "order_id",
        "account_id",
        "instrument_id",
        "side",
        "order_type",
        to_whole("quantity").alias("quantity"),
        F.col("limit_price").try_cast("double").alias("limit_price"),
        "status",
        "disclosure_status",
        created.alias("created_at"),
        F.col("__at").alias("updated_at"),
        is_buy(F.col("side")).alias("is_buy"),
        F.date_trunc("hour", created).alias("order_hour"),
        *(_ties(tie_breakers) if keep_ties else ()),
    )


def curate_order_stream(raw: DataFrame, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """One typed row per event of the streamed order-event shape."""
    live = raw.where(not_blank("ticker", "event_type")).withColumn("__at", parse_timestamp("timestamp"))
    return latest_by_key(live, ["event_id"], ["__at"], tie_breakers).select(
        "event_id",
        "event_type",
        "ticker",
        "side",
        to_whole("quantity").alias("quantity"),
        "order_id",
        "account_id",
        "instrument_id",
        F.col("__at").alias("event_timestamp"),
        is_buy(F.col("side")).alias("is_buy"),
        F.date_trunc("hour", "__at").alias("event_hour"),
    )


def typed_entity(raw: DataFrame, entity: Entity, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """The images of a source table's log, typed, with `__op` and the columns of `event_order`; a narrow step."""
    if "after" in raw.columns:
        prefix, op, at = "after.", "op", F.timestamp_millis("source_timestamp")
    else:
        prefix, op, at = "", "_cdc.op", F.col("_cdc.ts")
    return raw.select(
        *[to_typed(F.col(prefix + name), kind).alias(name) for name, kind in entity.columns.items()],
        F.col(op).alias("__op"),
        at.alias(EVENT_AT),
        *_ties(tie_breakers),
    ).where(F.col(entity.key).isNotNull())


def curate_entity(
    raw: DataFrame, entity: Entity, tie_breakers: Sequence[str] = (), *, keep_order: bool = False
) -> DataFrame:
    """Newest non-deleted row per key of any source table, typed.

    Reads both raw shapes: the envelope (`op`, `after`, `source_timestamp`) and the flat row with a
    `_cdc` struct. `keep_order` adds the columns of `event_order`, for tables that increments are merged into.
    """
    stamped = {*entity.event_time_on_insert, *entity.event_time}
    typed = typed_entity(raw, entity, tie_breakers)
    newest = apply_changes(typed, [entity.key], [EVENT_AT], tie_names(tie_breakers), op="__op")
    return newest.select(
        *[F.col(EVENT_AT).alias(name) if name in stamped else F.col(name) for name in entity.output_columns],
        *(event_order(tie_breakers) if keep_order else ()),
    )


def event_order(tie_breakers: Sequence[str] = ()) -> tuple[str, ...]:
    """What decides which of two rows of an entity is newer: the event's time, then the tie breakers."""
    return (EVENT_AT, *tie_names(tie_breakers))


def merge_spec(entity: Entity, order: Sequence[str] = ()) -> MergeSpec:
    """On a match every column but the key and the insert-only ones is refreshed; with `order`, only by rows that
    are not older."""
    frozen = {entity.key, *entity.event_time_on_insert}
    names = [*entity.output_columns, *order]
    return MergeSpec(
        keys=(entity.key,),
        update={n: n for n in names if n not in frozen},
        insert={n: n for n in names},
        order=tuple(order),
    )


def merge_entity(target: DataFrame, raw: DataFrame, entity: Entity, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Current state of a source table after a batch of changes."""
    return merge_upsert(target, curate_entity(raw, entity, tie_breakers), merge_spec(entity))
