"""Summaries from changed rows only, against summaries of all rows."""

import random
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.summaries import finish_market, market_summary
from tidemark.operators.upsert import union_upsert
from tidemark.plans.curated import derive_tick_columns
from tidemark.plans.summary_deltas import SummaryDeltas, changed_images, market_hours
from tidemark.session import staged
from tidemark.sources.hourly import hour_text

TICK = "tick_id string, ticker string, bid double, ask double, last_price double, volume bigint, instrument_id bigint, tick_timestamp timestamp"
START = datetime(2026, 3, 2, 10)


def ticks(spark, data):
    rows_ = [(f"t{k}", name, p - 0.1, p + 0.2, p, v, 1, START + timedelta(minutes=m) if m is not None else None) for k, name, p, v, m in data]
    return derive_tick_columns(spark.createDataFrame(rows_, TICK))


def apply(spark, summary, state, batch, number):
    signed = changed_images(state, batch, ["tick_id"], ["tick_timestamp"])
    summary.apply(signed, number)
    return staged(union_upsert(state, batch, ["tick_id"], ["tick_timestamp"]), "state")


def whole(state):
    return rows(market_summary(state))


def found(summary):
    return rows(finish_market(summary.current(), ["ticker", "tick_hour"]))


def test_random_corrections_equal_a_new_computation(spark, path):
    rng = random.Random(3)
    first = ticks(spark, [])
    summary, state = SummaryDeltas(spark, path, market_hours(), first.schema, "day"), first
    for number in range(1, 5):
        keys = rng.sample(range(40), 25)
        data = [(k, rng.choice("AB"), rng.choice([1.1, 2.7, 0.3]), rng.choice([None, 5, 7]), rng.randrange(400) + 100 * number) for k in keys]
        state = apply(spark, summary, state, ticks(spark, data + [(100 + number, "A", 1.0, 1, None)]), number)
        assert found(summary) == whole(state)


def test_groups_empty_and_late_rows_lose(spark, path):
    first = ticks(spark, [(1, "A", 5.0, 3, 10), (2, "A", 7.0, None, 20), (3, "B", 2.0, 1, 700)])
    summary = SummaryDeltas(spark, path, market_hours(), first.schema)
    state = apply(spark, summary, first.limit(0), first, 1)
    assert found(summary) == whole(state)
    moved = ticks(spark, [(3, "B", 2.5, 1, 800), (1, "A", 4.0, 9, 5)])  # an hour becomes empty; an older version changes nothing
    state = apply(spark, summary, state, moved, 2)
    assert found(summary) == whole(state)
    assert {(r["ticker"], r["tick_count"]) for r in summary.current().collect()} == {("A", 2), ("B", 1)}
    signed = changed_images(state, ticks(spark, [(4, "A", 1.0, 1, 30)]), ["tick_id"], ["tick_timestamp"])
    summary.apply(signed, 3)
    once = found(summary)
    summary.apply(signed, 3)  # the same batch again
    assert found(summary) == once
    volumes = {r["ticker"]: r["total_volume"] for r in summary.current().collect()}
    assert volumes["A"] == 4


def test_only_touched_hours_are_read(spark, path):
    first = ticks(spark, [(1, "A", 5.0, 3, 10), (2, "A", 7.0, 4, 20), (3, "B", 2.0, 1, 700), (4, "B", 3.0, 1, 710)])
    summary = SummaryDeltas(spark, path, market_hours(), first.schema)
    state = apply(spark, summary, first.limit(0), first, 1)
    seen, inner = [], type(summary.images).read

    def read(self, hours=None, *, with_batch=False):
        if self is summary.images and hours is not None:
            seen.append((list(hours), inner(self, hours).count()))
        return inner(self, hours, with_batch=with_batch)

    type(summary.images).read = read
    try:
        state = apply(spark, summary, state, ticks(spark, [(5, "A", 9.0, 1, 30)]), 2)  # a gain: no row is read
        assert seen == []
        state = apply(spark, summary, state, ticks(spark, [(1, "A", 6.0, 3, 40)]), 3)  # a correction: its hour
        hour = first.where("tick_id = 't1'").select(hour_text(F.col("tick_hour"))).first()[0]
        assert seen == [([hour], 5)]  # three rows, one taken out and one put in
    finally:
        type(summary.images).read = inner
    assert found(summary) == whole(state)
    plan = summary.rows_of([hour])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_part" in plan


def test_rows_delivered_again_change_nothing_and_no_hour_is_named_one_by_one(spark, path):
    data = [(k, "AB"[k % 2], 1.0 + k, 3, 60 * k) for k in range(30)]  # thirty hours of two days
    first = ticks(spark, data)
    summary = SummaryDeltas(spark, path, market_hours(), first.schema, "day")
    state = apply(spark, summary, first.limit(0), first, 1)
    assert changed_images(state, first, ["tick_id"], ["tick_timestamp"]).count() == 0
    moved, inner = [], type(summary.images).read

    def read(self, hours=None, *, with_batch=False):
        if hours is not None:
            moved.append(list(hours))
        return inner(self, hours, with_batch=with_batch)

    type(summary.images).read = read
    try:
        state = apply(spark, summary, state, ticks(spark, [(k, name, p + 1, v, m) for k, name, p, v, m in data]), 2)
    finally:
        type(summary.images).read = inner
    assert moved and all(set(hours) <= {"2026-03-02", "2026-03-03"} for hours in moved)
    assert found(summary) == whole(state)
