"""State at many moments, and joins of bucketed tables."""

from datetime import datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.history import as_of_lookup, state_at, validity
from tidemark.operators.trading import enrich_executions
from tidemark.sources.catalog import create_bucketed

LOG = "k bigint, at timestamp, seq int, op string, v string"
T0 = datetime(2026, 3, 2, 10)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def log(spark):
    data = [
        (1, at(0), 1, "c", "a"), (1, at(10), 2, "u", "b"), (1, at(20), 3, "d", "b"), (1, at(40), 4, "c", "again"),
        (2, at(5), 1, "c", "x"), (2, at(5), 2, "u", "y"),  # two images of one moment: the later one counts
        (3, None, 1, "c", "never"), (4, at(0), 1, "d", "gone"),
    ]
    return spark.createDataFrame(data, LOG).repartition(3)


def brute(data, moment):
    state = {}
    for k, when, seq, op, v in sorted((r for r in data if r[1] is not None and r[1] <= moment), key=lambda r: (r[1], r[2])):
        state[k] = None if op == "d" else v
    return {k: v for k, v in state.items() if v is not None}


def intervals(spark):
    return validity(log(spark), ["k"], "at", ["seq"], deleted=F.col("op") == "d")


def test_state_at_every_moment(spark):
    data = [tuple(r) for r in log(spark).collect()]
    moments = [at(m) for m in range(-1, 60)]
    found = {}
    for r in state_at(intervals(spark), [m.replace(tzinfo=timezone.utc) for m in moments]).collect():
        found.setdefault(r["as_of"], {})[r["k"]] = r["v"]
    assert found == {m: s for m in moments if (s := brute(data, m))}
    assert state_at(intervals(spark), []).count() == 0
    plan = state_at(intervals(spark), [T0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lookups_by_key_and_moment(spark):
    data = [tuple(r) for r in log(spark).collect()]
    asked = [(n, k, at(m)) for n, (k, m) in enumerate((k, m) for k in (1, 2, 3, 4, 5) for m in (-5, 0, 5, 10, 25, 40, 99))]
    found = as_of_lookup(spark.createDataFrame(asked, "n int, k bigint, moment timestamp"), intervals(spark), ["k"], "moment")
    expected = sorted((n, brute(data, m)[k]) for n, k, m in asked if k in brute(data, m))
    assert rows(found, "n", "v") == sorted(expected, key=repr)


def test_bucketed_tables_join_without_a_shuffle(spark, path):
    trades = spark.range(2000).selectExpr("id as trade_id", "if(id % 3 = 0, 7, id % 500) as order_id", "1.0 as quantity", "2.0 as price", "current_timestamp() as executed_at")
    orders = spark.range(500).selectExpr("id as order_id", "id as account_id", "'BUY' as side")
    stored = [create_bucketed(df, f"bucketed_{name}", f"{path}/{name}", ["order_id"], 8) for name, df in (("t", trades), ("o", orders))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = enrich_executions(*stored)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in "to":
            spark.sql(f"DROP TABLE bucketed_{name}")
