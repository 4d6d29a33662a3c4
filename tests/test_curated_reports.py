"""Golden values from hand-made rows in the shape of the platform's seed data."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import parse_date, parse_timestamp, settlement_date, stable_round, to_whole
from tidemark.model import ACCOUNTS, ORDERS, TRADES
from tidemark.operators import summaries, trading
from tidemark.plans.curated import curate_entity, curate_order_events, curate_order_stream, merge_entity

ORDER_ROW = (
    "order_id string, account_id string, instrument_id string, side string, quantity string, order_type string, "
    "limit_price string, status string, disclosure_status string, created_at string, updated_at string"
)


def order(number, side, quantity, status="FILLED", updated="2026-03-02T10:05:00Z", price=None, instrument="1"):
    created = "2026-03-02T10:01:00Z"
    return (number, "1", instrument, side, quantity, "LIMIT", price, status, "MNPI", created, updated)


def flat_log(spark, *entries):
    return spark.createDataFrame(
        [(*row, (op, offset)) for offset, (op, row) in enumerate(entries)],
        ORDER_ROW + ", _cdc struct<op: string, offset: bigint>",
    )


def test_order_events(spark):
    log = flat_log(
        spark,
        ("c", order("1", "BUY", "1000.0000", "PENDING", "2026-03-02T10:01:00Z", "185.50")),
        ("u", order("1", "BUY", "1000.7500", "FILLED", price="185.50")),
        ("c", order("2", None, "n/a", "PENDING")),
        ("d", order("2", None, "5", "PENDING", "2026-03-02T11:00:00Z")),
        ("c", order(None, "BUY", "1")),
        (None, order("3", "BUY", "1")),
    )
    curated = curate_order_events(log, ["_cdc.offset"])
    assert rows(curated, "order_id", "quantity", "limit_price", "status", "is_buy") == [
        ("1", 1000, 185.5, "FILLED", True),
        ("2", None, None, "PENDING", None),
    ]
    assert "_cdc" not in curated.columns
    assert curated.first()["order_hour"] == datetime(2026, 3, 2, 10)
    without_meta = curate_order_events(log.drop("_cdc").where("order_id = '2'"))
    assert rows(without_meta, "quantity") == [(5,)]


def test_order_stream_drops_blank_rows(spark):
    raw = spark.createDataFrame(
        [
            ("e1", "ORDER_CREATED", "AAPL", "BUY", "10", 1, 1, 1, "2026-03-02T10:00:00Z"),
            ("e1", "ORDER_CREATED", "AAPL", "SELL", "12", 1, 1, 1, "2026-03-02T10:30:00Z"),
            ("e2", "", "AAPL", "BUY", "10", 1, 1, 1, "2026-03-02T10:00:00Z"),
            ("e3", "ORDER_CREATED", None, "BUY", "10", 1, 1, 1, "2026-03-02T10:00:00Z"),
        ],
        "event_id string, event_type string, ticker string, side string, quantity string, order_id int, "
        "account_id int, instrument_id int, timestamp string",
    )
    assert rows(curate_order_stream(raw), "event_id", "quantity", "is_buy") == [("e1", 12, False)]


def test_order_summary_counts_unknown_sides_in_the_total_only(spark):
    events = spark.createDataFrame(
        [("1", True, 10), ("1", True, 20), ("1", False, 31), ("1", None, None), ("2", True, 1)],
        "instrument_id string, is_buy boolean, quantity bigint",
    ).select("*", F.lit(datetime(2026, 3, 2)).alias("created_at"))
    report = summaries.order_summary(events, ["instrument_id"])
    assert rows(
        report, "instrument_id", "total_orders", "buy_orders", "sell_orders", "total_volume", "avg_order_size",
        "buy_sell_ratio",
    ) == [("1", 4, 2, 1, 61, 20, 2.0), ("2", 1, 1, 0, 1, 1, None)]


def tick_frame(spark, *data):
    return spark.createDataFrame(
        [(tid, "AAPL", price, 1, s, m, at, at.replace(minute=0, second=0, microsecond=0)) for tid, price, s, m, at in data],
        "tick_id string, ticker string, last_price double, volume bigint, spread double, mid_price double, "
        "tick_timestamp timestamp, tick_hour timestamp",
    )


def test_market_summary_and_rollup(spark):
    ticks = tick_frame(
        spark,
        ("a", None, 0.2, 10.0, datetime(2026, 3, 2, 10, 0)),
        ("b", 12.0, 0.2, 10.0, datetime(2026, 3, 2, 10, 5)),
        ("c", 11.0, 0.2, 10.0, datetime(2026, 3, 2, 10, 59)),
        ("d", 20.0, 0.4, 0.0, datetime(2026, 3, 2, 11, 0)),
    )
    hourly = summaries.market_summary(ticks)
    assert rows(hourly, "tick_count", "open_price", "close_price", "low_price", "high_price", "avg_price") == [
        (1, 20.0, 20.0, 20.0, 20.0, 20.0),
        (3, None, 11.0, 11.0, 12.0, 11.5),
    ]
    assert rows(hourly, "spread_pct") == [(2.0,), (None,)]
    whole = summaries.market_summary(ticks, ["ticker"])
    assert rows(whole, "tick_count", "open_price", "close_price", "avg_price") == [(4, None, 20.0, 14.33)]
    measures = summaries.market_measures(ticks, ["ticker", "tick_hour"])
    rolled = summaries.finish_market(summaries.roll_up_market(measures, ["ticker"]), ["ticker"])
    assert rows(rolled) == rows(whole)


def test_summaries_do_not_depend_on_partitioning(spark):
    base = spark.range(2000).select(
        F.concat(F.lit("t"), "id").alias("tick_id"),
        F.lit("X").alias("ticker"),
        (F.pmod(F.hash("id"), F.lit(1000)) / 100).alias("last_price"),
        F.lit(1).cast("bigint").alias("volume"),
        F.lit(0.1).alias("spread"),
        F.lit(5.0).alias("mid_price"),
        # every timestamp occurs often, so open and close have ties
        F.timestamp_seconds(F.lit(1772445600) + F.col("id") % 10).alias("tick_timestamp"),
    ).withColumn("tick_hour", F.date_trunc("hour", "tick_timestamp"))
    results = [rows(summaries.market_summary(base.repartition(n, "tick_id"))) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    low, high, start, end = summaries.market_summary(base).select("low_price", "high_price", "open_price", "close_price").first()
    assert low <= start <= high and low <= end <= high


def test_open_and_close_need_no_sort(spark):
    ticks = tick_frame(spark, ("a", 1.0, 0.1, 1.0, datetime(2026, 3, 2)))
    plan = summaries.market_summary(ticks)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_entity_reads_both_raw_shapes(spark):
    flat = spark.sql(
        "SELECT '7' account_id, 'Alpha' account_name, 'FUND' account_type, 'ACTIVE' status, "
        "'2026-01-01T00:00:00Z' created_at, struct('r' AS op, timestamp'2026-01-02' AS ts) _cdc"
    )
    wrapped = spark.sql(
        "SELECT 'r' op, struct('7' AS account_id, 'Alpha' AS account_name, 'FUND' AS account_type, 'ACTIVE' AS status, "
        "'2026-01-01T00:00:00Z' AS created_at) after, 1767312000000L source_timestamp"
    )
    assert rows(curate_entity(flat, ACCOUNTS)) == rows(curate_entity(wrapped, ACCOUNTS)) == [
        (7, "Alpha", "FUND", "ACTIVE", datetime(2026, 1, 1))
    ]


def envelope(spark, *events):
    fields = ", ".join(f"{n}: string" for n in ORDERS.columns)
    blank = dict.fromkeys(ORDERS.columns)
    data = [(op, {**blank, **image} if image else None, ms) for op, image, ms in events]
    return spark.createDataFrame(data, f"op string, after struct<{fields}>, source_timestamp bigint")


def test_order_merge_sets_created_at_once_and_from_event_time(spark):
    start = curate_entity(envelope(spark, ("c", {"order_id": "1", "quantity": "5"}, 1_000)), ORDERS)
    batch = envelope(
        spark,
        ("u", {"order_id": "1", "quantity": "6.5"}, 2_000),
        ("u", {"order_id": "1", "quantity": "6"}, 1_500),
        ("c", {"order_id": "2", "quantity": "1"}, 3_000),
        ("d", None, 4_000),
    )
    merged = merge_entity(start, batch, ORDERS)
    second = lambda s: datetime(1970, 1, 1, 0, 0, s)
    assert rows(merged, "order_id", "quantity", "created_at", "updated_at") == [
        (1, D("6.5000"), second(1), second(2)),
        (2, D("1.0000"), second(3), second(3)),
    ]


@pytest.fixture(scope="module")
def book(spark):
    """Orders, trades, accounts and instruments of a small trading day."""
    day = datetime(2026, 3, 2, 10)
    orders = spark.createDataFrame([(1, 1, "BUY"), (2, 1, "SELL"), (3, 2, "BUY")], "order_id bigint, account_id bigint, side string")
    trades = spark.createDataFrame(
        [
            (1, 1, 1, D(1100), D("92.40"), "ARCA", day),
            (2, 2, 1, D(200), D("190.00"), "ARCA", day.replace(hour=11)),
            (3, 2, 1, D(100), D("191.00"), "ARCA", day.replace(hour=11)),
            (4, 3, 7, D(4200), D("311.15"), "BATS", day),
        ],
        "trade_id bigint, order_id bigint, instrument_id bigint, quantity decimal(18,4), price decimal(18,4), "
        "execution_venue string, executed_at timestamp",
    )
    accounts = spark.createDataFrame([(1, "Alpha", "FUND"), (2, "Beta", "FUND")], "account_id bigint, account_name string, account_type string")
    instruments = spark.createDataFrame([(1, "AAPL", "Apple Inc."), (7, "SPY", "S&P 500")], "instrument_id bigint, ticker string, name string")
    return orders, trades, accounts, instruments


def test_positions_and_report(book):
    orders, trades, accounts, instruments = book
    positions = trading.build_positions(trades, orders)
    assert rows(positions, "account_id", "instrument_id", "quantity", "last_price", "market_value") == [
        (1, 1, D("800.0000"), D("191.0000"), D("152800.00")),
        (2, 7, D("4200.0000"), D("311.1500"), D("1306830.00")),
    ]
    report = trading.position_report(positions, accounts, instruments)
    assert rows(report, "account_name", "ticker", "implied_price") == [("Alpha", "AAPL", D("191.00")), ("Beta", "SPY", D("311.15"))]


def test_positions_need_no_sort(book):
    orders, trades, _, _ = book
    positions = trading.build_positions(trades, orders)
    for df in (positions, trading.fold_positions(positions, positions)):
        assert "SortAggregate" not in df._jdf.queryExecution().toString()


def test_position_report_with_zero_quantity(spark, book):
    _, _, accounts, instruments = book
    flat = spark.sql("SELECT 1L account_id, 1L instrument_id, 0.0 quantity, 10.0 market_value, date'2026-03-02' position_date")
    assert rows(trading.position_report(flat, accounts, instruments), "implied_price") == [(None,)]


def test_trade_summary(book):
    _, trades, _, instruments = book
    report = trading.trade_summary_daily(trades, instruments)
    assert rows(report, "trade_date", "ticker", "trade_count", "total_quantity", "total_notional", "avg_price") == [
        (date(2026, 3, 2), "AAPL", 3, D("1400.0000"), D("158740.00000000"), D("157.8000")),
        (date(2026, 3, 2), "SPY", 1, D("4200.0000"), D("1306830.00000000"), D("311.1500")),
    ]


def test_trade_summary_joins_after_aggregating(book):
    _, trades, _, instruments = book
    plan = trading.trade_summary_daily(trades, instruments)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Aggregate" in plan[:join] and "Aggregate" in plan[join:]


def test_net_position_and_notional(spark):
    orders = spark.createDataFrame(
        [(1, 1, "BUY", D(10)), (1, 1, "SELL", D(4)), (2, 1, "SELL", D(5)), (2, 2, "BUY", D(6))],
        "account_id int, instrument_id int, side string, quantity decimal(18,4)",
    )
    top = [tuple(r) for r in trading.net_position(orders, 2).collect()]
    assert top == [(1, 1, D("6.0000"), 2), (2, 2, D("6.0000"), 1)]
    filled = spark.createDataFrame(
        [("FILLED", 1, 2.0, 3.0), ("PARTIALLY_FILLED", 1, 1.0, 1.0), ("NEW", 1, 9.0, 9.0)],
        "status string, instrument_id int, quantity double, price double",
    ).withColumn("event_timestamp", F.lit(datetime(2026, 3, 2)))
    assert rows(trading.daily_notional(filled), "trade_count", "notional_volume") == [(2, 7.0)]


def test_skewed_join_is_split(spark, tmp_path):
    """One order holding a third of all trades: adaptive execution splits its partition."""
    trades = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("order_id"),
        F.col("id").alias("trade_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"),
    )
    orders = spark.range(300_000).select(F.col("id").alias("order_id"), F.lit(1).alias("account_id"), F.lit("BUY").alias("side"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = trading.enrich_executions(trades, orders)
        assert joined.count() == 300_000
        joined.write.mode("overwrite").parquet(str(tmp_path / "joined"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_casts(spark):
    row = spark.sql(
        "SELECT '1000.7500' q, 'x' bad, '2026-02-28T15:30:00Z' z, '2026-02-28T17:30:00+02:00' o, "
        "'20512' epoch_day, '2026-02-28' iso, 2.675d near, date'2026-02-27' d"
    ).select(
        to_whole("q").alias("q"),
        to_whole("bad").alias("bad"),
        parse_timestamp("z").alias("z"),
        (parse_timestamp("z") == parse_timestamp("o")).alias("same"),
        parse_timestamp("bad").alias("nots"),
        parse_date("epoch_day").alias("e"),
        parse_date("iso").alias("i"),
        parse_date("bad").alias("nodate"),
        stable_round(F.col("near"), 2).alias("near"),
        settlement_date(F.col("d")).alias("settles"),
    ).first()
    assert (row.q, row.bad, row.same, row.nots, row.nodate) == (1000, None, True, None, None)
    assert row.z == datetime(2026, 2, 28, 15, 30)
    assert row.e == date(2026, 2, 28) and row.i == date(2026, 2, 28)
    assert row.near == 2.68
    assert row.settles == date(2026, 3, 1)


def test_trades_read_settlement_in_both_forms(spark):
    fields = ", ".join(f"{n}: string" for n in TRADES.columns)
    blank = dict.fromkeys(TRADES.columns)
    data = [
        ("c", {**blank, "trade_id": "1", "settlement_date": "20512"}, 1),
        ("c", {**blank, "trade_id": "2", "settlement_date": "2026-02-28"}, 1),
    ]
    raw = spark.createDataFrame(data, f"op string, after struct<{fields}>, source_timestamp bigint")
    assert rows(curate_entity(raw, TRADES), "settlement_date") == [(date(2026, 2, 28),)] * 2
