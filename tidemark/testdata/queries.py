"""Every operator of the library as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import settlement_date
from tidemark.functions.casts import epoch_ms_to_date
from tidemark.model import (
    ACCOUNTS,
    ENTITIES,
    INSTRUMENTS,
    MESSAGE_CONTRACTS,
    ORDERS,
    POSITIONS,
    TABLE_CONTRACTS,
    TOPIC_ROUTES,
    TRADES,
    Entity,
)
from tidemark.operators import access, constraints, contracts, quality, routing, summaries, trading
from tidemark.operators.cdc import unwrap_cdc
from tidemark.operators.dedup import apply_changes
from tidemark.operators.history import as_of_lookup, compare_counts, row_changes, state_at, validity
from tidemark.operators.upsert import union_upsert
from tidemark.plans.curated import (
    curate_entity,
    curate_market_ticks,
    curate_order_events,
    curate_order_stream,
    event_order,
    merge_entity,
    tie_names,
    typed_entity,
    typed_ticks,
)
from tidemark.plans.incremental import run_entity, run_incremental
from tidemark.plans.summary_deltas import SummaryDeltas, changed_images, market_hours, order_hours
from tidemark.plans.medallion import MedallionTables, run_medallion
from tidemark.session import COMPRESSION, shuffles_released, staged, tune, work_dir
from tidemark.sources import feed
from tidemark.sources.audit import parse_audit, read_audit_log
from tidemark.sources.catalog import create_bucketed, create_table_as, get_watermark, set_watermark, table_exists
from tidemark.sources.hourly import HourlyRows
from tidemark.sources.messages import parse_messages
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming.curate import bar_table, current_bars, curate_stream, dedup_stream, ohlc_live_stream, ohlc_store_stream
from tidemark.streaming.ingest import ingest_stream, route_stream, routed_rows
from tidemark.streaming.positions import current_positions, position_deltas, position_stream
from tidemark.testdata import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines print alike: no zone, date or decimal types."""

    def simple(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("decimal(38,4)").cast("double")
        return column.alias(field.name)

    return df.select(*[simple(f) for f in df.schema.fields])


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return plain(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


# ------------------------------------------------------------------ curated ticks, market summary

TIES = ("event_id",)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_market_ticks(adapters.raw_ticks(spark, sf_dir), TIES)


@query
def market_ticks_curated(spark, sf_dir):
    return _ticks(spark, sf_dir)


@query
def market_summary_hourly(spark, sf_dir):
    return summaries.market_summary(_ticks(spark, sf_dir))


@query
def market_summary_ticker(spark, sf_dir):
    report = summaries.market_summary(_ticks(spark, sf_dir), ["ticker"], ohlc=False)
    return report.orderBy(F.desc("total_volume"))


@query
def market_rollup_daily(spark, sf_dir):
    hourly = summaries.market_measures(_ticks(spark, sf_dir), ["ticker", "tick_hour"])
    daily = hourly.withColumn("tick_day", F.date_trunc("day", "tick_hour"))
    grain = ["ticker", "tick_day"]
    return summaries.finish_market(summaries.roll_up_market(daily, grain), grain)


# ---------------------------------------------------------------------------------------- orders


def _flat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = adapters.order_changes(spark, sf_dir)
    return unwrap_cdc(changes, ORDERS.image_schema().names, "order_id", target="raw_mnpi.orders")


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_order_events(_flat_orders(spark, sf_dir), ["_cdc.offset"])


@query
def order_events_curated(spark, sf_dir):
    return _order_events(spark, sf_dir)


@query
def order_stream_curated(spark, sf_dir):
    events = adapters.raw_ticks(spark, sf_dir)
    raw = events.select(
        F.col("tick_id").alias("event_id"),
        F.when(F.col("event_id") % 40 == 0, "").otherwise("ORDER_CREATED").alias("event_type"),
        "ticker",
        F.when(F.col("event_id") % 2 == 0, "BUY").when(F.col("event_id") % 3 == 0, "SELL").alias("side"),
        F.col("last_price").alias("quantity"),
        F.col("event_id").alias("order_id"),
        F.lit("1").alias("account_id"),
        "instrument_id",
        "timestamp",
    )
    return curate_order_stream(raw, ["order_id"])


@query
def order_stream_summary(spark, sf_dir):
    """The per-ticker order summary over the streamed order events."""
    events = order_stream_curated(spark, sf_dir)
    return summaries.order_summary(
        events, ["ticker"], event_time="event_timestamp", whole_average=False
    ).orderBy(F.desc("total_volume"))


@query
def order_summary_hourly(spark, sf_dir):
    return summaries.order_summary(_order_events(spark, sf_dir))


@query
def order_summary_instrument(spark, sf_dir):
    return summaries.order_summary(_order_events(spark, sf_dir), ["instrument_id"])


@query
def order_rollup_daily(spark, sf_dir):
    hourly = summaries.order_measures(_order_events(spark, sf_dir), ["instrument_id", "order_hour"])
    daily = hourly.withColumn("order_day", F.date_trunc("day", "order_hour"))
    grain = ["instrument_id", "order_day"]
    return summaries.finish_orders(summaries.roll_up_orders(daily, grain), grain)


def _current_orders(spark: SparkSession, sf_dir: str, deletes: str) -> DataFrame:
    rows = _flat_orders(spark, sf_dir)
    state = apply_changes(rows, ["order_id"], ["_cdc.ts"], ["_cdc.offset"], op="_cdc.op", deletes=deletes)
    return state.select("order_id", "status", "side", F.col("_cdc.op").alias("last_op"), F.col("_cdc.ts").alias("changed_at"))


@query
def order_current_state_keep_last(spark, sf_dir):
    return _current_orders(spark, sf_dir, "keep_last")


@query
def order_current_state_remove(spark, sf_dir):
    return _current_orders(spark, sf_dir, "remove")


@query
def order_current_state_tombstone(spark, sf_dir):
    return _current_orders(spark, sf_dir, "tombstone")


# ------------------------------------------------------------------------------- entity merges


def _merged(changes: DataFrame, entity: Entity, ties: tuple[str, ...]) -> DataFrame:
    """State after the first batch, then the second batch merged into it."""
    first = curate_entity(changes.where(F.col("batch") == 1), entity, ties)
    return merge_entity(first, changes.where(F.col("batch") > 1), entity, ties)


@query
def merge_orders(spark, sf_dir):
    return _merged(adapters.order_changes(spark, sf_dir), ORDERS, ("offset",))


@query
def merge_trades(spark, sf_dir):
    return _merged(adapters.trade_changes(spark, sf_dir), TRADES, ("log_position",))


@query
def merge_positions(spark, sf_dir):
    return _merged(adapters.position_changes(spark, sf_dir), POSITIONS, ("log_position",))


@query
def merge_accounts(spark, sf_dir):
    return _merged(adapters.account_changes(spark, sf_dir), ACCOUNTS, ())


@query
def merge_instruments(spark, sf_dir):
    return _merged(adapters.instrument_changes(spark, sf_dir), INSTRUMENTS, ())


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_entity(adapters.trade_changes(spark, sf_dir), TRADES, ("log_position",))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_entity(adapters.account_changes(spark, sf_dir), ACCOUNTS)


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_entity(adapters.instrument_changes(spark, sf_dir), INSTRUMENTS)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_entity(adapters.order_changes(spark, sf_dir), ORDERS, ("offset",))


@query
def current_trades(spark, sf_dir):
    return _trades(spark, sf_dir)


@query
def current_accounts(spark, sf_dir):
    return _accounts(spark, sf_dir)


@query
def current_instruments(spark, sf_dir):
    return _instruments(spark, sf_dir)


# ------------------------------------------------------------------------------------- reports


@query
def trade_summary_daily(spark, sf_dir):
    report = trading.trade_summary_daily(_trades(spark, sf_dir), _instruments(spark, sf_dir))
    return report.orderBy(F.desc("trade_date"), F.desc("total_notional"))


@query
def report_as_table(spark, sf_dir):
    """The order summary as a catalog table that did not exist before, read back with the watermark kept at it."""
    name = f"tidemark_{uuid.uuid4().hex}"
    before = table_exists(spark, name)
    create_table_as(summaries.order_summary(_order_events(spark, sf_dir)), name, work_dir(spark, "report"))
    set_watermark(spark, name, 3)
    noted = {"existed": F.lit(before), "exists": F.lit(table_exists(spark, name)), "watermark": F.lit(get_watermark(spark, name)).cast("bigint")}
    return spark.table(name).withColumns(noted)


@query
def orders_by_change_day(spark, sf_dir):
    """Changes of orders by the day of the log's milliseconds."""
    changes = adapters.order_changes(spark, sf_dir)
    return changes.groupBy(epoch_ms_to_date("source_timestamp").alias("day"), "op").agg(F.count(F.lit(1)).alias("changes"))


@query
def executions_enriched(spark, sf_dir):
    rows = trading.enrich_executions(_trades(spark, sf_dir), _orders(spark, sf_dir))
    due = settlement_date(F.to_date("executed_at")).alias("settlement_due")
    return rows.select("trade_id", "order_id", "account_id", "side", "quantity", "price", "settlement_date", due)


@query
def executions_bucketed(spark, sf_dir):
    """Enriched executions from trades and orders that are stored by order: joined bucket by bucket."""
    root, name = work_dir(spark, "bucketed"), f"tidemark_{uuid.uuid4().hex}"
    sides = {"trades": _trades(spark, sf_dir), "orders": _orders(spark, sf_dir)}
    trades, orders = (create_bucketed(df, f"{name}_{k}", f"{root}/{k}", ["order_id"], 8) for k, df in sides.items())
    rows = trading.enrich_executions(trades, orders)
    due = settlement_date(F.to_date("executed_at")).alias("settlement_due")
    return rows.select("trade_id", "order_id", "account_id", "side", "quantity", "price", "settlement_date", due)


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.build_positions(_trades(spark, sf_dir), _orders(spark, sf_dir))


@query
def position_build(spark, sf_dir):
    return _positions(spark, sf_dir)


@query
def position_fold(spark, sf_dir):
    """Positions of the earlier executions, then the later ones added; the oracle builds them at once."""
    trades, orders = _trades(spark, sf_dir), _orders(spark, sf_dir)
    late = F.hour("executed_at") > 3
    stored = trading.build_positions(trades.where(~late), orders)
    return trading.fold_positions(stored, trading.build_positions(trades.where(late), orders))


@query
def position_report(spark, sf_dir):
    report = trading.position_report(
        _positions(spark, sf_dir), _accounts(spark, sf_dir), _instruments(spark, sf_dir)
    )
    return report.orderBy("account_name", F.desc("market_value"))


@query
def net_position_top(spark, sf_dir):
    return trading.net_position(_orders(spark, sf_dir), 100)


@query
def daily_notional_top(spark, sf_dir):
    rows = trading.enrich_executions(_trades(spark, sf_dir), _orders(spark, sf_dir), ["status"])
    return trading.daily_notional(rows, ["FILLED", "PARTIAL"], 200, event_time="executed_at")


# ----------------------------------------------------------------------------- versions, history


def _tick_table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Raw ticks as an append-only table of four snapshots."""
    raw = VersionedTable(spark, work_dir(spark, "raw-ticks"))
    raw.load_history(adapters.raw_ticks(spark, sf_dir), "batch", committed_at="arrived_at")
    return raw


RAW_TICK_COLUMNS = ("event_id", "tick_id", "ticker", "last_price")


@query
def ticks_as_of_version(spark, sf_dir):
    return _tick_table(spark, sf_dir).read_as_of(2, with_snapshot=True).select("snapshot_id", *RAW_TICK_COLUMNS)


@query
def ticks_as_of_timestamp(spark, sf_dir):
    raw = _tick_table(spark, sf_dir)
    when = raw.commits()[2].committed_at
    return raw.read_as_of(timestamp=when, with_snapshot=True).select("snapshot_id", *RAW_TICK_COLUMNS)


@query
def ticks_between_versions(spark, sf_dir):
    return _tick_table(spark, sf_dir).read_between(1, 3, with_snapshot=True).select("snapshot_id", *RAW_TICK_COLUMNS)


@query
def snapshot_listing(spark, sf_dir):
    return _tick_table(spark, sf_dir).snapshots().select("snapshot_id", "committed_at", "operation")


@query
def snapshot_history(spark, sf_dir):
    return _tick_table(spark, sf_dir).history()


@query
def snapshot_compare(spark, sf_dir):
    return compare_counts(_tick_table(spark, sf_dir))


@query
def snapshot_row_changes(spark, sf_dir):
    raw = _tick_table(spark, sf_dir)
    before = curate_market_ticks(raw.read_as_of(3), TIES)
    after = curate_market_ticks(raw.read_as_of(4), TIES)
    return row_changes(before, after, ["tick_id"])


@query
def curated_as_of_version(spark, sf_dir):
    return curate_market_ticks(_tick_table(spark, sf_dir).read_as_of(2), TIES)


def _order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each image of an order was the current one; a delete ends it."""
    log = _flat_orders(spark, sf_dir).withColumn("changed_at", F.col("_cdc.ts").cast("timestamp"))
    images = validity(log, ["order_id"], "changed_at", [F.col("_cdc.offset")], deleted=F.col("_cdc.op") == "d")
    return images.select(F.col("order_id").cast("bigint").alias("order_id"), "status", "quantity", "valid_from", "valid_to")


@query
def orders_as_of_many(spark, sf_dir):
    """Every execution with the status that its order had at that moment."""
    trades = _trades(spark, sf_dir).select("trade_id", "order_id", "executed_at")
    found = as_of_lookup(trades, _order_intervals(spark, sf_dir), ["order_id"], "executed_at")
    return found.select("trade_id", "order_id", "executed_at", "status", "valid_from")


@query
def orders_as_of_moments(spark, sf_dir):
    """Orders by status at the ends of five years, from one pass over the log."""
    ends = [datetime(year, 12, 31, 23, tzinfo=timezone.utc) for year in range(1994, 1999)]
    states = state_at(_order_intervals(spark, sf_dir), ends)
    return states.groupBy("as_of", "status").agg(F.count(F.lit(1)).alias("orders"))


@query
def incremental_equals_full(spark, sf_dir):
    """Four incremental runs; the oracle is one full refresh."""
    raw = _tick_table(spark, sf_dir)
    target = VersionedTable(spark, work_dir(spark, "ticks"), bucket_keys=["tick_id"], buckets=16)

    ties = tie_names(TIES)

    def transform(rows: DataFrame) -> DataFrame:
        return curate_market_ticks(rows, TIES, keep_ties=True)

    target.replace(transform(raw.read_as_of(1)), watermark=1)
    for _ in range(3):
        run_incremental(
            "ticks", raw, target, transform, ["tick_timestamp"], quality.no_nulls("ticker"), tie_breakers=ties, max_snapshots=1
        )
    return target.read().drop(*ties)


@query
def full_refresh_after_increments(spark, sf_dir):
    """Two increments, then a full refresh by its flag, which takes in what is left; the oracle is the whole table."""
    raw = _tick_table(spark, sf_dir)
    target = VersionedTable(spark, work_dir(spark, "ticks"), bucket_keys=["tick_id"], buckets=16)
    given = (lambda rows: curate_market_ticks(rows, TIES, keep_ties=True), ["tick_timestamp"], quality.no_nulls("ticker"))
    target.replace(given[0](raw.read_as_of(1)), watermark=1)
    run_incremental("ticks", raw, target, *given, tie_breakers=tie_names(TIES), max_snapshots=2)
    result = run_incremental("ticks", raw, target, *given, tie_breakers=tie_names(TIES), full_refresh=True)
    return target.read().drop(*tie_names(TIES)).withColumns({"mode": F.lit(result.mode), "watermark": F.lit(result.watermark).cast("bigint")})


@query
def empty_increment(spark, sf_dir):
    """A snapshot without usable rows: nothing is written, but the watermark moves, and the next run has nothing to do."""
    raw, ticks = _tick_table(spark, sf_dir), adapters.raw_ticks(spark, sf_dir)
    target = VersionedTable(spark, work_dir(spark, "ticks"), bucket_keys=["tick_id"], buckets=16)
    given = (lambda rows: curate_market_ticks(rows, TIES), ["tick_timestamp"], {})
    results = [run_incremental("ticks", raw, target, *given)]
    raw.append(ticks.where(F.col("ticker") == "").select(*raw.read().columns))
    results += [run_incremental("ticks", raw, target, *given) for _ in range(2)]
    stored = target.read().count()
    rows = [(k, r.mode, r.watermark, r.row_count, target.watermark(), stored) for k, r in enumerate(results)]
    return spark.createDataFrame(
        rows, "run long, mode string, watermark long, row_count long, stored_watermark long, stored_rows long"
    )


@query
def incremental_entity_merge(spark, sf_dir):
    """Orders merged batch by batch into a stored table, rewriting touched buckets only."""
    raw = VersionedTable(spark, work_dir(spark, "raw-orders"))
    raw.load_history(adapters.order_changes(spark, sf_dir), "batch", committed_at="arrived_at")
    target = VersionedTable(spark, work_dir(spark, "orders"), bucket_keys=["order_id"], buckets=16)
    target.replace(curate_entity(raw.read_as_of(1), ORDERS, ("offset",), keep_order=True), watermark=1)
    run_entity(ORDERS, raw, target, ("offset",))
    return target.read().select(*ORDERS.output_columns)


def _folded_summary(spark, raw, curate, order_by, ties, keys, spec, unit) -> DataFrame:
    """The measures of a summary kept through four batches of changes with corrections of earlier rows."""
    root, kept = work_dir(spark, "summary"), tie_names(ties)
    state, summary = None, None
    for batch in range(1, 5):
        increment = staged(curate(raw.where(F.col("batch") == batch)), "increment")
        if summary is None:
            state, summary = increment.limit(0), SummaryDeltas(spark, root, spec, increment.schema, unit)
        summary.apply(changed_images(state, increment, keys, order_by, kept), batch)
        state = staged(union_upsert(state, increment, keys, order_by, kept), "state")
    return summary.current()


@query
def market_summary_deltas(spark, sf_dir):
    """The hourly market summary from changed ticks; the oracle computes it as a whole."""
    raw = adapters.raw_ticks(spark, sf_dir)
    measures = _folded_summary(
        spark, raw, lambda rows: curate_market_ticks(rows, TIES, keep_ties=True), ["tick_timestamp"], TIES, ["tick_id"], market_hours(), "day"
    )
    return summaries.finish_market(measures, ["ticker", "tick_hour"])


@query
def order_summary_deltas(spark, sf_dir):
    """The hourly order summary from changed orders; the oracle computes it as a whole."""
    raw, ties = _flat_orders(spark, sf_dir), ("_cdc.offset",)
    measures = _folded_summary(
        spark, raw, lambda rows: curate_order_events(rows, ties, keep_ties=True), ["updated_at"], ties, ["order_id"], order_hours(), "year"
    )
    return summaries.finish_orders(measures, ["instrument_id", "order_hour"])


def _late(spark: SparkSession, changes: DataFrame, entity: Entity, ties: tuple[str, ...]) -> DataFrame:
    """The stored entity after its batches have arrived in reverse, one run each, without insert-only times."""
    raw = VersionedTable(spark, work_dir(spark, f"late-{entity.name}"))
    arrived = raw.load_history(changes.withColumn("batch", 4 - F.col("batch")), "batch")
    target = VersionedTable(spark, work_dir(spark, f"late-{entity.name}-state"), bucket_keys=[entity.key], buckets=16)
    target.replace(curate_entity(raw.read_as_of(arrived[0]), entity, ties, keep_order=True), watermark=arrived[0])
    for _ in arrived[1:]:
        run_entity(entity, raw, target, ties, max_snapshots=1)
    return target.read().select(*[c for c in entity.output_columns if c not in entity.event_time_on_insert])


@query
def late_orders(spark, sf_dir):
    return _late(spark, adapters.order_changes(spark, sf_dir), ORDERS, ("offset",))


@query
def late_trades(spark, sf_dir):
    return _late(spark, adapters.trade_changes(spark, sf_dir), TRADES, ("log_position",))


@query
def late_positions(spark, sf_dir):
    return _late(spark, adapters.position_changes(spark, sf_dir), POSITIONS, ("log_position",))


@query
def late_accounts(spark, sf_dir):
    return _late(spark, adapters.account_changes(spark, sf_dir), ACCOUNTS, ()).drop("created_at")


@query
def late_instruments(spark, sf_dir):
    return _late(spark, adapters.instrument_changes(spark, sf_dir), INSTRUMENTS, ()).drop("created_at")


@query
def schema_evolution_append(spark, sf_dir):
    """A later append brings a new column; older rows read as NULL."""
    events = adapters.table(spark, sf_dir, "events").withColumn("batch", adapters.batch_number())
    table = VersionedTable(spark, work_dir(spark, "evolving"))
    table.append(events.where(F.col("batch") < 3).select("event_id", "event_type"))
    table.append(events.where(F.col("batch") >= 3).select("event_id", "event_type", "value"))
    return table.read(with_snapshot=True)


# ------------------------------------------------------------------------------ quality, contracts


@query
def quality_gate_metrics(spark, sf_dir):
    ticks = _ticks(spark, sf_dir)
    checks = {**quality.no_nulls("ticker"), **quality.no_nulls("volume"), **quality.not_empty()}
    metrics = quality.quality_metrics(ticks, checks)
    return metrics.select(
        "row_count",
        F.col("no null ticker").alias("no_null_ticker"),
        F.col("no null volume").alias("no_null_volume"),
        F.col("row_count > 0").alias("not_empty"),
    )


@query
def file_profile(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events")
    profile = quality.file_profile(events, "user_id", "ts")
    return profile.orderBy(F.desc("latest_event")).limit(50)


@query
def table_row_counts(spark, sf_dir):
    return quality.row_counts({name: adapters.table(spark, sf_dir, name) for name in TABLES})


@query
def table_freshness(spark, sf_dir):
    ticks = _tick_table(spark, sf_dir)
    orders = VersionedTable(spark, work_dir(spark, "raw-orders"))
    orders.load_history(adapters.order_changes(spark, sf_dir), "batch", committed_at="arrived_at")
    now = F.lit(max(c.committed_at for t in (ticks, orders) for c in t.commits()))
    return quality.freshness({"market_data": ticks.ledger(), "orders": orders.ledger()}, now)


def _suspect_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat order log with broken rows: wrong side, unreadable quantity, missing status."""
    rows = _flat_orders(spark, sf_dir)
    number = F.col("order_id").cast("bigint")
    return (
        rows.withColumn("side", F.when(number % 11 == 0, "SWAP").otherwise(F.col("side")))
        .withColumn("quantity", F.when(number % 13 == 0, "n/a").otherwise(F.col("quantity")))
        .withColumn("status", F.when(number % 17 != 0, F.col("status")))
    )


@query
def contract_violations(spark, sf_dir):
    tagged = contracts.tag_violations(_suspect_orders(spark, sf_dir), TABLE_CONTRACTS["orders"])
    return tagged.select(F.explode("violations").alias("violation")).groupBy("violation").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query
def contract_quarantine(spark, sf_dir):
    _, quarantine = contracts.check_contract(_suspect_orders(spark, sf_dir), TABLE_CONTRACTS["orders"])
    return quarantine.select(
        "order_id", F.col("_cdc.op").alias("op"), F.concat_ws("; ", "violations").alias("violations")
    )


@query
def contract_valid(spark, sf_dir):
    valid, _ = contracts.check_contract(_suspect_orders(spark, sf_dir), TABLE_CONTRACTS["orders"])
    return valid.select("order_id", F.col("_cdc.op").alias("op"), "status")


@query
def message_validation(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders")
    number = F.col("o_orderkey")
    record = F.struct(
        number.cast("string").alias("order_id"),
        F.lit("7").alias("instrument_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.when(number % 11 == 0, "SWAP").otherwise("BUY").alias("side"),
        F.lit("LIMIT").alias("order_type"),
        F.when(number % 13 != 0, F.col("o_totalprice")).alias("quantity"),
        F.lit("NEW").alias("status"),
        number.alias("timestamp_ms"),
    )
    texted = F.regexp_replace(F.to_json(record), '"quantity":([0-9.E]+)', '"quantity":"$1"')
    value = (
        F.when(number % 19 == 0, F.concat(F.lit("{oops "), F.to_json(record)))
        .when(number % 17 == 0, texted)
        .otherwise(F.to_json(record))
    )
    rows = orders.select(number.alias("order_id"), value.alias("value"))
    tagged = contracts.tag_message_violations(rows, MESSAGE_CONTRACTS["order-events"])
    return tagged.select("order_id", F.concat_ws("; ", "violations").alias("violations"))


@query
def market_data_contract(spark, sf_dir):
    """Tick messages against the contract of market data: some lack a symbol, some have a fractional or a textual volume."""
    events = adapters.table(spark, sf_dir, "events")
    number, price = F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("double")
    record = F.struct(
        F.col("user_id").cast("string").alias("instrument_id"),
        F.when(number % 13 != 0, F.upper("event_type")).alias("symbol"),
        (price - 0.25).alias("bid_price"),
        (price + 0.25).alias("ask_price"),
        price.alias("last_price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
        number.alias("timestamp_ms"),
    )
    text = F.to_json(record)
    broken = (
        F.when(number % 17 == 0, F.regexp_replace(text, '"volume":([0-9]+)', '"volume":$1.5'))
        .when(number % 19 == 0, F.regexp_replace(text, '"volume":([0-9]+)', '"volume":"$1"'))
        .otherwise(text)
    )
    tagged = contracts.tag_message_violations(events.select("event_id", broken.alias("value")), MESSAGE_CONTRACTS["market-data"])
    return tagged.where(F.size("violations") > 0).select("event_id", F.concat_ws("; ", "violations").alias("violations"))


@query
def unique_violations(spark, sf_dir):
    return contracts.find_duplicates(adapters.raw_ticks(spark, sf_dir), ["tick_id"])


@query
def fk_orphans(spark, sf_dir):
    """Trades whose order has been deleted."""
    known = _current_orders(spark, sf_dir, "remove").select(F.col("order_id").cast("bigint").alias("order_id"))
    lines = adapters.table(spark, sf_dir, "lineitem")
    return contracts.find_orphans(lines, "l_orderkey", known, "order_id").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


def _source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five source tables as text: orders without the deleted ones, of the others all images of their logs."""
    orders = apply_changes(_flat_orders(spark, sf_dir), ["order_id"], ["_cdc.ts"], ["_cdc.offset"], op="_cdc.op", deletes="remove")
    positions = adapters.position_changes(spark, sf_dir).where(F.col("op") != "d")
    return {
        "orders": orders.select(*ORDERS.image_schema().names),
        "trades": adapters.trade_changes(spark, sf_dir).select("after.*"),
        "positions": positions.select("after.*"),
        "accounts": adapters.account_changes(spark, sf_dir).select(*ACCOUNTS.columns),
        "instruments": adapters.instrument_changes(spark, sf_dir).select("after.*"),
    }


def _quarantined(spark: SparkSession, sf_dir: str, **kinds: bool) -> DataFrame:
    """The rows of all five tables that break a constraint, with the constraints they break."""
    checked = constraints.check_constraints(_source_tables(spark, sf_dir), TABLE_CONTRACTS, **kinds)
    rows = None
    for entity in ENTITIES.values():
        _, quarantine = checked[entity.name]
        part = quarantine.select(
            F.lit(entity.name).alias("table_name"),
            F.col(entity.key).cast("bigint").alias("row_key"),
            F.concat_ws("; ", "violations").alias("violations"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query
def contract_unique(spark, sf_dir):
    return _quarantined(spark, sf_dir, references=False)


@query
def contract_references(spark, sf_dir):
    return _quarantined(spark, sf_dir, unique=False)


# -------------------------------------------------------------------------------- routing, messages

TOPIC_OF_EVENT = {
    "signup": "cdc.trading.accounts",
    "purchase": "cdc.trading.public.orders",
    "click": "cdc.trading.public.trades",
    "view": "stream.market-data",
    "error": "stream.market-data-dlq",
}


def _with_topic(events: DataFrame) -> DataFrame:
    topics = F.create_map(*[F.lit(x) for pair in TOPIC_OF_EVENT.items() for x in pair])
    return events.withColumn("_topic", routing.short_topic(F.element_at(topics, F.col("event_type"))))


@query
def topic_routing_counts(spark, sf_dir):
    events = _with_topic(adapters.table(spark, sf_dir, "events"))
    routed = routing.route(events).groupBy("table", "zone").agg(F.count(F.lit(1)).alias("row_count"))
    rest = routing.unrouted(events).agg(F.count(F.lit(1)).alias("row_count"))
    return routed.unionByName(rest.select(F.lit("unrouted").alias("table"), F.lit("none").alias("zone"), "row_count"))


def _parsed_orders(spark: SparkSession, sf_dir: str):
    return parse_messages(adapters.order_messages(spark, sf_dir), ORDERS.envelope_schema())


@query
def cdc_unwrap(spark, sf_dir):
    rows = unwrap_cdc(_parsed_orders(spark, sf_dir).valid, ORDERS.image_schema().names, "order_id")
    return rows.select(
        "_topic",
        "order_id",
        "side",
        "quantity",
        "limit_price",
        "status",
        "updated_at",
        F.col("_cdc.op").alias("op"),
        F.col("_cdc.key").alias("key"),
        F.col("_cdc.ts").alias("ts"),
        F.col("_cdc.offset").alias("log_offset"),
    )


@query
def cdc_unwrap_drop(spark, sf_dir):
    valid = _parsed_orders(spark, sf_dir).valid
    return unwrap_cdc(valid, ["order_id", "status", "updated_at"], "order_id", deletes="drop")


@query
def message_quarantine(spark, sf_dir):
    return _parsed_orders(spark, sf_dir).quarantine.select("_topic", F.col("offset").alias("log_offset"), "reason")


# -------------------------------------------------------------------------------------------- feed


@query
def feed_quotes_to_ticks(spark, sf_dir):
    return feed.quotes_to_ticks(adapters.feed_messages(spark, sf_dir), adapters.feed_instruments(spark, sf_dir))


@query
def feed_trades_to_orders(spark, sf_dir):
    return feed.trades_to_orders(
        adapters.feed_messages(spark, sf_dir), adapters.feed_instruments(spark, sf_dir), account_id=3
    )


@query
def feed_quarantine(spark, sf_dir):
    """Messages cut short, quotes without a bid and trades with an unreadable price, with the reason."""
    messages, turn = adapters.feed_messages(spark, sf_dir), F.col("event_id") % 5
    broken = (
        F.when(turn == 0, F.expr("left(value, length(value) - 1)"))
        .when(turn == 1, F.regexp_replace("value", '"bp"', '"xp"'))
        .when(turn == 2, F.regexp_replace("value", '"p":', '"p":"n/a","pp":'))
        .otherwise(F.col("value"))
    )
    found = feed.parse_feed(messages.select(broken.alias("value"))).quarantine
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))


# ------------------------------------------------------------------------------------------ access


@query
def access_matrix(spark, sf_dir):
    return access.access_matrix(adapters.tagged_resources(spark, sf_dir))


@query
def audit_access_report(spark, sf_dir):
    records = parse_audit(adapters.audit_records(spark, sf_dir))
    return access.audit_report(records, access.access_matrix(access.standard_databases(spark)))


@query
def audit_file_report(spark, sf_dir):
    """The access report from audit files of JSON lines."""
    folder = work_dir(spark, "audit")
    adapters.audit_records(spark, sf_dir).select("value").write.text(folder)
    return access.audit_report(read_audit_log(spark, folder), access.access_matrix(access.standard_databases(spark)))


# --------------------------------------------------------------------------------------- streaming


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of four shuffled files, one per micro-batch, so that each batch has late rows.

    Row groups of a few MB let several tasks read one file.
    """
    events, folder = adapters.table(spark, sf_dir, "events"), work_dir(spark, "event-stream")
    events.repartition(4, F.xxhash64("event_id")).write.option("parquet.block.size", 4 << 20).parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finish(stream) -> None:
    stream.awaitTermination()


@query
def stream_ingest_routed(spark, sf_dir):
    """Events as messages of five topics, appended to the raw tables they route to."""
    root = work_dir(spark, "ingest")
    names = ("raw_nonmnpi.accounts", "raw_mnpi.orders", "raw_mnpi.trades", "raw_nonmnpi.market_data")
    tables = {name: VersionedTable(spark, f"{root}/{name}") for name in names}
    messages = _with_topic(_event_stream(spark, sf_dir))
    _finish(ingest_stream(messages, tables, f"{root}/checkpoint", available_now=True))
    stored = None
    for name, table in tables.items():
        if table.exists():
            rows = table.read().select(F.lit(name).alias("table_name"), "event_id", "_topic")
            stored = rows if stored is None else stored.unionByName(rows)
    return stored


@query
def ingest_in_one_write(spark, sf_dir):
    """How many messages went to each table, as counted while they were written, and as they stand there; some have no topic."""
    root, counts = work_dir(spark, "routed"), {}
    topic = F.when(F.col("event_id") % 23 != 0, F.col("_topic"))
    messages = _with_topic(_event_stream(spark, sf_dir)).withColumn("_topic", topic)

    def add(batch: int, seen: dict[str, int]) -> None:
        counts[batch] = seen

    _finish(route_stream(messages, f"{root}/rows", f"{root}/checkpoint", counted=add, available_now=True))
    stored = routed_rows(spark, f"{root}/rows", messages.schema)
    noted = [(name, n) for seen in counts.values() for name, n in seen.items() if n]
    written = spark.createDataFrame(noted, "table string, n long").groupBy("table").agg(F.sum("n").alias("counted"))
    return stored.groupBy("zone", "table").agg(F.count(F.lit(1)).alias("row_count")).join(written, "table")


@query
def ingest_unrouted(spark, sf_dir):
    """Messages of topics without a rule, kept in the dead-letter table."""
    root = work_dir(spark, "dead-letters")
    tables = {r.table: VersionedTable(spark, f"{root}/{r.table}") for r in TOPIC_ROUTES}
    kept = VersionedTable(spark, f"{root}/unrouted")
    messages = _with_topic(_event_stream(spark, sf_dir))
    _finish(ingest_stream(messages, tables, f"{root}/checkpoint", available_now=True, dead_letters=kept))
    return kept.read().select("event_id", "_topic")


@query
def stream_curated_ticks(spark, sf_dir):
    """The curated ticks, folded batch by batch from a stream."""
    root = work_dir(spark, "curate")
    target = VersionedTable(spark, f"{root}/ticks", bucket_keys=["tick_id"], buckets=16)
    raw = adapters.ticks_from_events(_event_stream(spark, sf_dir))
    _finish(
        curate_stream(
            raw,
            target,
            lambda rows: curate_market_ticks(rows, TIES),
            ["tick_timestamp"],
            f"{root}/checkpoint",
            available_now=True,
        )
    )
    return target.read()


@query
def stream_ohlc(spark, sf_dir):
    """Ticks stored by hour, late hours repaired from their partitions, live ones kept as state."""
    root = work_dir(spark, "ohlc")
    ticks = typed_ticks(adapters.ticks_from_events(_event_stream(spark, sf_dir)))
    store, bars = HourlyRows(spark, f"{root}/ticks", ticks.schema, "tick_timestamp", "day"), bar_table(spark, f"{root}/bars")
    _finish(ohlc_store_stream(ticks, store, bars, f"{root}/store-checkpoint", available_now=True))
    _finish(ohlc_live_stream(store, bars, f"{root}/live-checkpoint", available_now=True))
    return current_bars(bars)


@query
def stream_positions(spark, sf_dir):
    """Positions from executions in four shuffled batches, all of them delivered twice."""
    root, ties = work_dir(spark, "positions"), ("log_position",)
    changes, folder = adapters.trade_changes(spark, sf_dir).drop("batch"), f"{root}/log"
    twice = changes.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    for batch in range(4):  # dealt by tasks that read, without a shuffle; files are streamed in the order of their writing
        dealt = twice.where(F.pmod(F.xxhash64("log_position", "delivery"), F.lit(4)) == batch).drop("delivery")
        dealt.write.mode("append").option("compression", COMPRESSION).parquet(folder)
    a_batch = -(-len(spark.read.schema(changes.schema).parquet(folder).inputFiles()) // 4)
    with shuffles_released(spark):
        owners = staged(_orders(spark, sf_dir).select("order_id", "account_id", "side"), "owners")

    def executions(log: DataFrame) -> DataFrame:
        rows = typed_entity(log, TRADES, ties).select("trade_id", "order_id", "instrument_id", "quantity", "price", "executed_at", *event_order(ties))
        return rows.join(owners, "order_id").withColumn("position_date", F.to_date("executed_at"))

    # The log is this query's own copy: the files of a batch go once it is committed.
    log = spark.readStream.schema(changes.schema).options(maxFilesPerTrigger=a_batch, cleanSource="delete").parquet(folder)
    state = VersionedTable(spark, f"{root}/state", bucket_keys=["trade_id"], buckets=16)
    positions = position_deltas(spark, f"{root}/positions", executions(changes), "year")
    order, later = event_order(ties)[:1], event_order(ties)[1:]
    _finish(position_stream(log, state, positions, f"{root}/checkpoint", order, later, transform=executions, versions=1, available_now=True))
    return current_positions(positions)


@query
def stream_dedup(spark, sf_dir):
    """Every event delivered twice, stored once."""
    root = work_dir(spark, "dedup")
    twice = _event_stream(spark, sf_dir).unionByName(_event_stream(spark, sf_dir))
    target = HourlyRows(spark, f"{root}/events", twice.schema, "ts", "day")
    _finish(dedup_stream(twice, target, ["event_id"], f"{root}/checkpoint", available_now=True))
    return target.read().select("event_id", "ts", "event_type", "value")


# --------------------------------------------------------------------------------------- whole run


@query
def medallion_run(spark, sf_dir):
    """Raw tables loaded, both curated jobs, both summaries; the report of the run."""
    tables = MedallionTables.under(spark, work_dir(spark, "medallion"))
    orders = _flat_orders(spark, sf_dir)
    tables.raw_orders.load_history(orders, "batch", committed_at="arrived_at")
    tables.raw_ticks.load_history(adapters.raw_ticks(spark, sf_dir), "batch", committed_at="arrived_at")
    results = run_medallion(tables, order_tie_breakers=("_cdc.offset",), tick_tie_breakers=TIES)
    rows = [(r.table, r.mode, r.watermark, r.row_count) for r in results]
    return spark.createDataFrame(rows, "table_name string, mode string, watermark bigint, row_count bigint")
