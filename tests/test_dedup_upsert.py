from datetime import datetime

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.dedup import apply_changes, latest_by_key
from tidemark.operators.upsert import MergeSpec, merge_upsert, union_upsert

LOG = "k string, op string, t int, seq int, v string"


def test_latest_row_wins_and_null_order_loses(spark):
    df = spark.createDataFrame([("a", "c", 1, 1, "x"), ("a", "u", 3, 2, "y"), ("a", "u", None, 3, "z")], LOG)
    assert rows(latest_by_key(df, ["k"], ["t"]), "v") == [("y",)]


def test_ties_are_settled_by_the_tie_breaker_whatever_the_row_order(spark):
    data = [("a", "u", 1, s, str(s)) for s in range(20)]
    for arranged in (data, data[::-1], data[10:] + data[:10]):
        df = spark.createDataFrame(arranged, LOG).repartition(5)
        assert rows(latest_by_key(df, ["k"], ["t"], ["seq"]), "v") == [("19",)]


def test_delete_modes(spark):
    df = spark.createDataFrame(
        [
            ("a", "c", 1, 1, "a1"),
            ("a", "d", 2, 2, None),
            ("b", "c", 1, 1, "b1"),
            ("b", None, 9, 2, "null op"),
            ("c", "d", 1, 1, None),
            ("c", "c", 2, 2, "back"),
        ],
        LOG,
    )
    keep = apply_changes(df, ["k"], ["t"], ["seq"])
    assert rows(keep, "k", "v") == [("a", "a1"), ("b", "b1"), ("c", "back")]
    removed = apply_changes(df, ["k"], ["t"], ["seq"], deletes="remove")
    assert rows(removed, "k", "v") == [("b", "b1"), ("c", "back")]
    stored = apply_changes(df, ["k"], ["t"], ["seq"], deletes="tombstone")
    assert rows(stored, "k", "op") == [("a", "d"), ("b", "c"), ("c", "c")]


def test_tombstone_state_keeps_a_late_update_from_reviving_a_key(spark):
    first = spark.createDataFrame([("a", "c", 1, 1, "a1"), ("a", "d", 5, 2, None)], LOG)
    late = spark.createDataFrame([("a", "u", 3, 3, "late")], LOG)
    state = apply_changes(first, ["k"], ["t"], ["seq"], deletes="tombstone")
    merged = union_upsert(state, late, ["k"], ["t"])
    assert rows(merged, "k", "op") == [("a", "d")]


def test_union_upsert_late_and_repeated_rows_change_nothing(spark):
    stored = spark.createDataFrame([("a", "u", 5, 1, "new")], LOG)
    late = spark.createDataFrame([("a", "u", 4, 0, "old"), ("b", "u", 1, 0, "b")], LOG)
    once = union_upsert(stored, late, ["k"], ["t"])
    assert rows(once, "k", "v") == [("a", "new"), ("b", "b")]
    assert rows(union_upsert(once, late, ["k"], ["t"])) == rows(once)


def test_merge_column_rules(spark):
    target = spark.createDataFrame([(1, "old", "t0", "t0"), (2, "keep", "t0", "t0")], "id int, v string, made string, seen string")
    source = spark.createDataFrame([(1, "new", "t1"), (3, "added", "t1")], "id int, v string, at string")
    spec = MergeSpec(
        keys=("id",),
        update={"v": "v", "seen": "at"},
        insert={"id": "id", "v": "v", "made": "at", "seen": "at"},
    )
    assert rows(merge_upsert(target, source, spec)) == [
        (1, "new", "t0", "t1"),
        (2, "keep", "t0", "t0"),
        (3, "added", "t1", "t1"),
    ]


def test_merge_updates_can_set_null(spark):
    target = spark.createDataFrame([(1, "old")], "id int, v string")
    source = spark.createDataFrame([(1, None)], "id int, v string")
    spec = MergeSpec(("id",), {"v": "v"}, {"id": "id", "v": "v"})
    assert rows(merge_upsert(target, source, spec)) == [(1, None)]


events = st.lists(
    st.tuples(st.sampled_from("abc"), st.integers(0, 6), st.booleans()),
    min_size=1,
    max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=events, cuts=st.lists(st.integers(0, 25), max_size=3))
def test_folding_increments_equals_one_full_run(spark, events, cuts):
    """Property: any split of the log into batches gives the state of the whole log."""
    log = [(k, "d" if dead else "u", t, i, f"{k}{i}") for i, (k, t, dead) in enumerate(events)]
    full = apply_changes(spark.createDataFrame(log, LOG), ["k"], ["t"], ["seq"], deletes="tombstone")
    newest = {}
    for row in log:
        best = newest.get(row[0])
        if best is None or (row[2], row[3]) > (best[2], best[3]):
            newest[row[0]] = row
    assert rows(full) == sorted(newest.values(), key=repr)
    bounds = sorted({0, len(log), *[c for c in cuts if c < len(log)]})
    state = None
    for start, end in zip(bounds, bounds[1:]):
        batch = spark.createDataFrame(log[start:end], LOG)
        step = apply_changes(batch, ["k"], ["t"], ["seq"], deletes="tombstone")
        state = step if state is None else union_upsert(state, step, ["k"], ["t"], ["seq"])
    assert rows(state) == rows(full)


def test_hot_key_sends_one_row_per_task(spark):
    """A key with a third of all rows: the group limit runs before the shuffle."""
    df = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t")
    )
    newest = latest_by_key(df, ["k"], ["t"])
    assert newest.where("k = 0").first()["t"] == 2997
    plan = newest._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert plan.index("Exchange") < partial, plan  # children print below their parents
    assert newest.count() == 2001


@pytest.mark.parametrize("when", [datetime(2024, 1, 1)])
def test_typed_time_decides_not_text(spark, when):
    from tidemark.plans.curated import curate_market_ticks

    raw = spark.createDataFrame(
        [
            ("t1", "A", "1", "2", "1.5", "3", 1, "2024-01-01T10:00:00+02:00"),
            ("t1", "A", "5", "6", "5.5", "3", 1, "2024-01-01T09:00:00Z"),
        ],
        "tick_id string, ticker string, bid string, ask string, last_price string, volume string, "
        "instrument_id int, timestamp string",
    )
    assert rows(curate_market_ticks(raw), "last_price") == [(5.5,)]
