from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.quality import QualityError
from tidemark.operators.summaries import market_summary
from tidemark.plans.curated import curate_market_ticks, typed_ticks
from tidemark.plans.medallion import MedallionTables, run_medallion
from tidemark.sources.hourly import HourlyRows
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import curate
from tidemark.streaming.curate import (
    bar_table,
    current_bars,
    curate_stream,
    dedup_stream,
    not_stored,
    ohlc_live_stream,
    ohlc_store_stream,
    repaired_bars,
)
from tidemark.streaming.ingest import ingest_stream

RAW = (
    "tick_id string, ticker string, bid string, ask string, last_price string, volume string, instrument_id string, "
    "timestamp string, event_id bigint"
)
START = datetime(2026, 3, 2, 10)


def tick(number, minutes, price="1.00", tick_id=None):
    at = (START + timedelta(minutes=minutes)).isoformat()
    return (tick_id or f"t{number}", "AAPL", price, price, price, "1", "1", at, number)


def files(spark, path, *batches, schema=RAW):
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/in/{number}")


def stream(spark, path, schema=RAW):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def test_curate_stream_folds_late_and_duplicate_rows(spark, path):
    first = [tick(1, 0, "1.00"), tick(2, 50, "2.00")]
    files(spark, path, first, [tick(3, 10, "9.00", "t2"), tick(4, 5, "4.00")], first)
    target = VersionedTable(spark, f"{path}/ticks", bucket_keys=["tick_id"], buckets=4)

    def run():
        curate_stream(
            stream(spark, path),
            target,
            lambda raw: curate_market_ticks(raw, ["event_id"]),
            ["tick_timestamp"],
            f"{path}/checkpoint",
            available_now=True,
        ).awaitTermination()

    run()
    assert rows(target.read(), "tick_id", "last_price") == [("t1", 1.0), ("t2", 2.0), ("t4", 4.0)]
    commits = len(target.commits())
    run()  # nothing new: no commit
    assert len(target.commits()) == commits


def ohlc(spark, path, source, name, delay="2 hours"):
    ticks = typed_ticks(stream(spark, source))
    store = HourlyRows(spark, f"{path}/ticks", ticks.schema, "tick_timestamp")
    bars = bar_table(spark, f"{path}/bars")
    ohlc_store_stream(ticks, store, bars, f"{path}/{name}-store", delay=delay, writer=name, available_now=True).awaitTermination()
    ohlc_live_stream(store, bars, f"{path}/live", delay=delay, available_now=True).awaitTermination()
    return store, bars


def test_ohlc_streams_over_batches_equal_the_batch_result(spark, path):
    batches = [
        [tick(1, 10, "5.00"), tick(2, 20, "7.00")],
        [tick(3, 5, "4.00"), tick(4, 70, "3.00"), tick(1, 10, "5.00")],  # one tick is delivered again
        [tick(5, 65, "8.00"), tick(6, 600, "1.00")],
    ]
    files(spark, path, *batches)
    store, bars = ohlc(spark, path, path, "first")
    found = current_bars(bars)
    assert rows(found, "bar_start", "open_price", "high_price", "low_price", "close_price", "tick_count") == [
        (START, 4.0, 7.0, 4.0, 7.0, 3),
        (START + timedelta(hours=1), 8.0, 8.0, 3.0, 3.0, 2),
        (START + timedelta(hours=10), 1.0, 1.0, 1.0, 1.0, 1),
    ]
    whole = spark.createDataFrame([t for b in batches for t in b], RAW)
    batch = market_summary(curate_market_ticks(whole))
    assert rows(batch, "open_price", "close_price") == rows(found, "open_price", "close_price")
    before = rows(found)
    ohlc(spark, path, path, "second")  # all files again under another name: nothing is counted twice
    assert rows(current_bars(bars)) == before


def test_live_state_takes_no_ticks_of_hours_that_the_store_has_repaired(spark, path):
    """One live batch that catches up on all stored ticks: only those of hours still open may enter its state."""
    files(spark, path, [tick(1, 10), tick(2, 70), tick(3, 600)], [tick(4, 590), tick(5, 20), tick(5, 20)])
    store, bars = ohlc(spark, path, path, "first")
    live = bars.read(with_batch=True).where("written_by = 'live'")
    assert rows(live, "bar_start", "tick_count") == [(START + timedelta(hours=9), 1), (START + timedelta(hours=10), 1)]
    assert rows(current_bars(bars), "bar_start", "tick_count") == [(START + timedelta(hours=h), n) for h, n in ((0, 2), (1, 1), (9, 1), (10, 1))]
    assert store.read().count() == 6
    with pytest.raises(ValueError, match="must not end"):
        ohlc_store_stream(stream(spark, path), store, bars, f"{path}/other", writer="x:closed")


def test_late_ticks_repair_their_hours_and_read_nothing_else(spark, path):
    files(spark, path, [tick(1, 10, "5.00"), tick(2, 3000, "7.00")])
    store, bars = ohlc(spark, path, path, "first")
    late = [tick(3, 1, "2.00"), tick(4, 2990, "6.00")]  # one hour is closed, the other one live
    files(spark, f"{path}/late", late)
    ohlc(spark, path, f"{path}/late", "late")
    assert rows(current_bars(bars), "bar_start", "open_price", "tick_count") == [
        (START, 2.0, 2),
        (START + timedelta(hours=49), 6.0, 1),
        (START + timedelta(hours=50), 7.0, 1),
    ]
    plan = repaired_bars(store, ["2026-03-02-10"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_part" in plan or "PartitionFilters: [(event_part" in plan
    scanned = repaired_bars(store, ["2026-03-02-10"]).inputFiles()
    assert scanned and len(store.read(["2026-03-02-10"]).inputFiles()) <= len(store.read().inputFiles())
    written = bars.read(with_batch=True).where("written_by = 'late'")
    assert [r["bar_start"] for r in written.collect()] == [START]  # only the closed hour was computed anew


def test_dedup_stream_in_two_tiers(spark, path):
    schema = "id bigint, ts timestamp"
    now = datetime.now().replace(microsecond=0)
    files(spark, path, [(1, START), (1, START), (9, now)], [(1, START), (2, START), (9, now)], schema=schema)
    source = stream(spark, path, schema)
    store = HourlyRows(spark, f"{path}/out", source.schema, "ts", "day")
    dedup_stream(source, store, ["id"], f"{path}/checkpoint", available_now=True).awaitTermination()
    assert rows(store.read(), "id") == [(1,), (2,), (9,)]
    ancient = START - timedelta(days=400)
    again = [(3, ancient), (1, START), (2, START), (4, None)]
    files(spark, f"{path}/late", again, [(3, ancient), (None, START), (None, START), (4, None)], schema=schema)
    late = stream(spark, f"{path}/late", schema)
    dedup_stream(late, store, ["id"], f"{path}/late-checkpoint", writer="late", available_now=True).awaitTermination()
    assert rows(store.read(), "id") == [(1,), (2,), (3,), (4,), (9,), (None,)]
    dedup_stream(late, store, ["id"], f"{path}/other-checkpoint", writer="other", available_now=True).awaitTermination()
    assert store.read().count() == 6


def test_recent_events_are_not_looked_up_and_old_ones_only_in_their_hours(spark, path, monkeypatch):
    schema = "id bigint, ts timestamp"
    looked_up = []
    monkeypatch.setattr(curate, "not_stored", lambda rows_, store_, hours, *rest: looked_up.append(hours) or not_stored(rows_, store_, hours, *rest))
    now = datetime.now().replace(microsecond=0)
    files(spark, path, [(1, now), (2, START)], [(3, now), (4, START + timedelta(hours=3))], schema=schema)
    source = stream(spark, path, schema)
    store = HourlyRows(spark, f"{path}/out", source.schema, "ts")
    dedup_stream(source, store, ["id"], f"{path}/checkpoint", available_now=True).awaitTermination()
    assert looked_up == [["2026-03-02-10"], ["2026-03-02-13"]]
    everything, one = store.read().inputFiles(), store.read(["2026-03-02-10"])
    assert len(everything) > 1 and one.count() == 1
    assert "PartitionFilters: [isnotnull(event_part" in one._jdf.queryExecution().executedPlan().toString()


def test_ingest_routes_and_decodes(spark, path):
    schema = "_topic string, value string"
    data = [("cdc.trading.orders", "1"), ("stream.market-data", "2"), ("heartbeat", "3")]
    files(spark, path, data, data[:1], schema=schema)
    tables = {
        name: VersionedTable(spark, f"{path}/{name}") for name in ("raw_mnpi.orders", "raw_nonmnpi.market_data")
    }
    ingest_stream(
        stream(spark, path, schema),
        tables,
        f"{path}/checkpoint",
        decode=lambda name, rows_: rows_.select(F.col("value").cast("int").alias("number"), F.lit(name).alias("t")),
        available_now=True,
    ).awaitTermination()
    assert rows(tables["raw_mnpi.orders"].read()) == [(1, "raw_mnpi.orders")] * 2
    assert rows(tables["raw_nonmnpi.market_data"].read(), "number") == [(2,)]
    assert len(tables["raw_mnpi.orders"].commits()) == 2


def test_ingest_keeps_unrouted_messages_and_refuses_missing_tables(spark, path):
    schema = "_topic string, value string"
    files(spark, path, [("cdc.trading.orders", "1"), ("heartbeat", "3"), (None, "4")], schema=schema)
    tables = {"raw_mnpi.orders": VersionedTable(spark, f"{path}/orders")}
    kept = VersionedTable(spark, f"{path}/kept")
    messages = stream(spark, path, schema)
    ingest_stream(messages, tables, f"{path}/c1", available_now=True, dead_letters=kept).awaitTermination()
    assert rows(kept.read().select("value")) == [("3",), ("4",)]
    assert rows(tables["raw_mnpi.orders"].read().select("value")) == [("1",)]
    with pytest.raises(Exception, match="raw_mnpi.orders"):
        ingest_stream(messages, {}, f"{path}/c2", available_now=True).awaitTermination()


ORDER = (
    "order_id string, account_id string, instrument_id string, side string, quantity string, order_type string, "
    "limit_price string, status string, disclosure_status string, created_at string, updated_at string"
)


def order(number):
    return (number, "1", "1", "BUY", "10", "LIMIT", None, "FILLED", "MNPI", START.isoformat(), START.isoformat())


def test_medallion_run_then_skip_then_increment(spark, path):
    tables = MedallionTables.under(spark, path, buckets=4)
    tables.raw_orders.append(spark.createDataFrame([order("1"), order("2")], ORDER))
    tables.raw_ticks.append(spark.createDataFrame([tick(1, 0), tick(2, 70)], RAW))
    first = run_medallion(tables)
    assert [(r.mode, r.row_count) for r in first] == [("full", 2), ("full", 2), ("full", 1), ("full", 2)]
    tables.raw_ticks.append(spark.createDataFrame([tick(3, 140)], RAW))
    second = run_medallion(tables)
    assert [(r.mode, r.row_count) for r in second] == [("skip", 0), ("incremental", 1), ("skip", 0), ("full", 3)]
    assert tables.market_summary.read().count() == 3
    third = run_medallion(tables, full_refresh=True)
    assert [(r.mode, r.row_count) for r in third] == [("full", 2), ("full", 3), ("full", 1), ("full", 3)]


def test_equal_times_give_the_same_rows_in_increments_and_in_full(spark, path):
    tables = MedallionTables.under(spark, path, buckets=4)
    tables.raw_orders.append(spark.createDataFrame([order("1")], ORDER))
    for price in ("9.0", "3.0", "5.0"):
        row = spark.createDataFrame([tick(1, 0)], RAW).withColumn("last_price", F.lit(price))
        tables.raw_ticks.append(row)
        run_medallion(tables)
    folded = rows(tables.market_ticks.read())
    run_medallion(tables, full_refresh=True)
    assert rows(tables.market_ticks.read()) == folded
    assert [r.last_price for r in tables.market_ticks.read().collect()] == [5.0]


def test_summaries_do_not_start_when_a_curated_job_fails(spark, path):
    tables = MedallionTables.under(spark, path, buckets=4)
    tables.raw_orders.append(spark.createDataFrame([order("1")], ORDER))
    tables.raw_ticks.append(spark.createDataFrame([tick(1, 0)], RAW).drop("ticker"))
    with pytest.raises(Exception, match="ticker"):
        run_medallion(tables)
    assert not tables.order_summary.exists() and not tables.market_summary.exists()
    assert tables.order_events.exists()


def test_empty_curated_data_fails_the_summary_gate(spark, path):
    tables = MedallionTables.under(spark, path, buckets=4)
    tables.raw_orders.append(spark.createDataFrame([order("1")], ORDER))
    tables.raw_ticks.append(spark.createDataFrame([tick(1, 0)], RAW).withColumn("ticker", F.lit("")))
    with pytest.raises(QualityError):
        run_medallion(tables)
    assert not tables.market_summary.exists()
