"""The TPC-H-like tables read as the raw data of a trading platform.

events -> market ticks and feed messages; orders -> order change log; lineitem -> trade change log;
customer -> accounts; part -> instruments; orders per customer -> positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso(column: Column) -> Column:
    return F.date_format(column, ISO)


def _text(column: Column, kind: str) -> Column:
    return column.cast(kind).cast("string")


def _ms(column: Column) -> Column:
    return F.unix_millis(column.cast("timestamp"))


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Raw ticks as text. One in five repeats the id of a neighbour; some tickers are blank or NULL."""
    number = F.col("event_id")
    price = F.col("value").cast("decimal(18,2)")
    cents = F.lit("0.05").cast("decimal(18,2)")
    ticker = F.when(number % 50 == 0, "").when(number % 51 == 0, None).otherwise(F.upper("event_type"))
    return events.select(
        F.concat(F.lit("t"), F.when(number % 5 == 4, number - 4).otherwise(number)).alias("tick_id"),
        ticker.alias("ticker"),
        (price - cents).cast("string").alias("bid"),
        (price + cents).cast("string").alias("ask"),
        price.cast("string").alias("last_price"),
        F.get_json_object("props", "$.k").alias("volume"),
        F.col("user_id").alias("instrument_id"),
        _iso(F.col("ts")).alias("timestamp"),
        "event_id",
        F.col("ts").cast("timestamp").alias("arrived_at"),
        batch_number(),
    )


def batch_number() -> Column:
    """Four batches by day of the month; one event in seven arrives a batch late."""
    week = F.floor((F.dayofmonth("ts") - 1) / 8).cast("bigint") + 1
    return F.when(F.col("event_id") % 7 == 0, F.least(week + 1, F.lit(4))).otherwise(week).alias("batch")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(table(spark, sf_dir, "events"))


def _events_of(rows: DataFrame, *events: Column) -> DataFrame:
    """One row per change event of each input row: one scan instead of a union of scans."""
    return rows.select(F.explode(F.array(*events)).alias("event"), *rows.columns).where(F.col("event").isNotNull())


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates, updates and deletes of orders, with the old or the new row image as text."""
    number = F.col("o_orderkey")
    limited = number % 3 == 0
    price = _text(F.col("o_totalprice") / 100, "decimal(18,4)")
    moved = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "P", "PARTIAL")

    def event(op: str, seq: int, hours: int, condition: Column) -> Column:
        created = F.timestamp_add("HOUR", (number % 24).cast("int"), F.col("o_orderdate"))
        at = F.timestamp_add("HOUR", F.lit(hours), created)
        image = F.struct(
            _text(number, "string").alias("order_id"),
            _text(F.col("o_custkey"), "string").alias("account_id"),
            _text(number % 50, "string").alias("instrument_id"),
            F.when(number % 2 == 0, "BUY").otherwise("SELL").alias("side"),
            _text(F.col("o_totalprice"), "decimal(18,4)").alias("quantity"),
            F.when(limited, "LIMIT").otherwise("MARKET").alias("order_type"),
            F.when(limited, price).alias("limit_price"),
            (F.lit("PENDING") if seq == 1 else F.coalesce(moved, F.lit("PENDING"))).alias("status"),
            F.when(number % 4 == 0, "DISCLOSED").otherwise("MNPI").alias("disclosure_status"),
            _iso(created).alias("created_at"),
            _iso(at).alias("updated_at"),
        )
        return F.when(
            condition,
            F.struct(F.lit(op).alias("op"), F.lit(seq).alias("seq"), at.alias("at"), image.alias("image")),
        )

    log = _events_of(
        table(spark, sf_dir, "orders"),
        event("c", 1, 0, F.lit(True)),
        event("u", 2, 1, F.col("o_orderstatus").isin("F", "P")),
        event("d", 3, 2, number % 97 == 0),
    )
    deleted = F.col("event.op") == "d"
    return log.select(
        F.lit("cdc.trading.orders").alias("_topic"),
        (number * 4 + F.col("event.seq")).alias("offset"),
        F.col("event.op").alias("op"),
        F.when(deleted, F.col("event.image")).alias("before"),
        F.when(~deleted, F.col("event.image")).alias("after"),
        _ms(F.col("event.at")).alias("source_timestamp"),
        F.col("event.seq").cast("bigint").alias("batch"),
        F.col("event.at").cast("timestamp").alias("arrived_at"),
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order changes as JSON messages. Every fourth is wrapped with its schema, some are broken
    and some are tombstones."""
    changes = order_changes(spark, sf_dir)
    number = F.col("offset")
    envelope = F.struct("op", "before", "after", "source_timestamp")
    wrapper = F.struct(F.struct(F.lit("struct").alias("type")).alias("schema"), envelope.alias("payload"))
    value = (
        F.when(number % 31 == 0, F.concat(F.lit("{broken "), F.to_json(envelope)))
        .when(number % 37 == 0, None)
        .when(number % 4 == 1, F.to_json(wrapper))
        .otherwise(F.to_json(envelope))
    )
    return changes.select("_topic", "offset", value.alias("value"))


def trade_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions; several rows may carry one trade id and are then versions of it."""
    lines = table(spark, sf_dir, "lineitem")
    at = F.timestamp_add("HOUR", F.col("l_linenumber"), F.col("l_shipdate"))
    settles = F.date_add(F.col("l_shipdate").cast("date"), 2)
    epoch_days = F.unix_date(settles).cast("string")
    venue = F.when(F.col("l_returnflag") == "A", "NYSE").when(F.col("l_returnflag") == "N", "NASDAQ")
    disclosure = F.when(F.col("l_linestatus") == "F", "DISCLOSED").otherwise("MNPI")
    image = F.struct(
        _text(F.col("l_orderkey") * 8 + F.col("l_linenumber"), "string").alias("trade_id"),
        _text(F.col("l_orderkey"), "string").alias("order_id"),
        _text(F.col("l_partkey"), "string").alias("instrument_id"),
        _text(F.col("l_quantity"), "decimal(18,4)").alias("quantity"),
        _text(F.col("l_extendedprice"), "decimal(18,4)").alias("price"),
        venue.otherwise("ARCA").alias("execution_venue"),
        F.when(F.col("l_linenumber") % 2 == 1, epoch_days)
        .otherwise(settles.cast("string"))
        .alias("settlement_date"),
        disclosure.alias("disclosure_status"),
        _iso(at).alias("executed_at"),
    )
    position = F.concat_ws(
        "|",
        _text(F.col("l_extendedprice"), "decimal(18,4)"),
        _text(F.col("l_quantity"), "decimal(18,4)"),
        F.col("l_partkey"),
        F.col("l_returnflag"),
        F.col("l_linestatus"),
    )
    return lines.select(
        F.lit("c").alias("op"),
        image.alias("after"),
        _ms(at).alias("source_timestamp"),
        position.alias("log_position"),
        F.when(F.year("l_shipdate") < 1999, 1).otherwise(2).alias("batch"),
    )


def position_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position rows restated with every order of a customer in an instrument."""
    orders = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey")
    image = F.struct(
        _text(F.col("o_custkey") * 50 + number % 50, "string").alias("position_id"),
        _text(F.col("o_custkey"), "string").alias("account_id"),
        _text(number % 50, "string").alias("instrument_id"),
        _text(number % 1000, "decimal(18,4)").alias("quantity"),
        _text(F.col("o_totalprice"), "decimal(18,2)").alias("market_value"),
        F.col("o_orderdate").cast("date").cast("string").alias("position_date"),
    )
    deleted = number % 89 == 0
    return orders.select(
        F.when(deleted, "d").otherwise("u").alias("op"),
        image.alias("after"),
        _ms(F.col("o_orderdate")).alias("source_timestamp"),
        number.alias("log_position"),
        F.when(F.year("o_orderdate") < 1998, 1).otherwise(2).alias("batch"),
    )


def account_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial load of all accounts, then closings of some; flat shape with a `_cdc` struct."""
    customers = table(spark, sf_dir, "customer")
    number = F.col("c_custkey")
    log = _events_of(
        customers,
        F.struct(F.lit("r").alias("op"), F.lit(1).alias("seq")),
        F.when(number % 10 == 0, F.struct(F.lit("u").alias("op"), F.lit(2).alias("seq"))),
    )
    kind = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "INDIVIDUAL").when(F.col("c_mktsegment") == "MACHINERY", "FUND")
    status = (
        F.when(F.col("event.seq") == 2, "CLOSED").when(F.col("c_acctbal") < 0, "SUSPENDED").otherwise("ACTIVE")
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_add("DAY", F.col("event.seq"), start)
    return log.select(
        number.alias("account_id"),
        F.col("c_name").alias("account_name"),
        kind.otherwise("INSTITUTIONAL").alias("account_type"),
        status.alias("status"),
        _iso(F.timestamp_add("DAY", F.col("c_nationkey"), start)).alias("created_at"),
        F.struct(F.col("event.op").alias("op"), at.cast("timestamp").alias("ts")).alias("_cdc"),
        F.col("event.seq").alias("batch"),
    )


def instrument_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial load of all instruments, then renamings of some; envelope shape."""
    parts = table(spark, sf_dir, "part")
    number = F.col("p_partkey")
    log = _events_of(
        parts,
        F.struct(F.lit("r").alias("op"), F.lit(1).alias("seq")),
        F.when(number % 20 == 0, F.struct(F.lit("u").alias("op"), F.lit(2).alias("seq"))),
    )
    renamed = F.when(F.col("event.seq") == 2, F.concat("p_name", F.lit(" (new)"))).otherwise(F.col("p_name"))
    kind = F.element_at(
        F.array(F.lit("EQUITY"), F.lit("BOND"), F.lit("ETF"), F.lit("OPTION")), (F.col("p_size") % 4 + 1).cast("int")
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    image = F.struct(
        _text(number, "string").alias("instrument_id"),
        F.concat(F.lit("T"), number).alias("ticker"),
        F.lpad(number.cast("string"), 9, "0").alias("cusip"),
        F.concat(F.lit("US"), F.lpad(number.cast("string"), 10, "0")).alias("isin"),
        renamed.alias("name"),
        kind.alias("instrument_type"),
        F.when(F.col("p_size") % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
    )
    return log.select(
        F.col("event.op").alias("op"),
        image.alias("after"),
        _ms(F.timestamp_add("DAY", F.col("event.seq"), start)).alias("source_timestamp"),
        F.col("event.seq").alias("batch"),
    )


def _json_object(fields: dict[str, Column]) -> Column:
    """A JSON object as text, without NULL fields. Names that differ only in case rule out a struct."""
    parts = [F.concat(F.lit(f'"{name}":'), value.cast("string")) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed messages: a quote and a trade per array, every fourth a single quote object; every ninth has an unknown symbol."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id")
    price = F.col("value").cast("decimal(18,2)")
    size = F.get_json_object("props", "$.k").cast("bigint")
    symbol = F.concat(F.when(number % 9 == 0, '"U').otherwise('"T'), F.col("user_id"), F.lit('"'))
    time = F.date_format("ts", "'\"'yyyy-MM-dd'T'HH:mm:ss.SSS'Z\"'")
    quote = _json_object(
        {
            "T": F.lit('"q"'),
            "S": symbol,
            "bp": price,
            "ap": price + F.lit("0.05").cast("decimal(18,2)"),
            "bs": size,
            "as": F.when(number % 3 != 0, size + 1),
            "t": time,
        }
    )
    trade = _json_object(
        {"T": F.lit('"t"'), "S": symbol, "p": price, "s": size, "i": number * 977 + 999_000, "t": time}
    )
    both = F.concat(F.lit("["), quote, F.lit(","), trade, F.lit("]"))
    return events.select("event_id", F.when(number % 4 == 0, quote).otherwise(both).alias("value"))


def feed_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruments the feed knows."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("instrument_id"), F.concat(F.lit("T"), F.col("p_partkey")).alias("ticker")
    )


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log lines as JSON text, one per event, touching one or two databases."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id")
    person = F.element_at(
        F.array(F.lit("finance-analyst"), F.lit("data-analyst"), F.lit("data-engineer")),
        (F.col("user_id") % 3 + 1).cast("int"),
    )
    names = F.array(
        *[
            F.lit(n)
            for n in (
                "raw_mnpi",
                "raw_nonmnpi",
                "curated_mnpi",
                "curated_nonmnpi",
                "analytics_mnpi",
                "analytics_nonmnpi",
            )
        ]
    )

    def resource(index: Column) -> Column:
        return F.struct(F.element_at(names, (index % 6 + 1).cast("int")).alias("arn"), F.lit("TABLE").alias("type"))

    resources = F.when(number % 5 == 0, F.array(resource(number), resource(number + 3))).otherwise(
        F.array(resource(number))
    )
    record = F.struct(
        F.struct(F.lit("user").alias("type"), person.alias("username")).alias("useridentity"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventtime"),
        F.when(F.col("event_type") == "error", "PutObject").otherwise("GetObject").alias("eventname"),
        resources.alias("resources"),
    )
    return events.select(F.to_json(record).alias("value"))


def tagged_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tagged resource per part; one in seven lacks the layer tag."""
    parts = table(spark, sf_dir, "part")
    number = F.col("p_partkey")
    layer = F.element_at(F.array(F.lit("raw"), F.lit("curated"), F.lit("analytics")), (number % 3 + 1).cast("int"))
    sensitivity = F.when(F.col("p_size") % 2 == 0, "mnpi").otherwise("non-mnpi")
    tags = F.when(number % 7 == 0, F.create_map(F.lit("sensitivity"), sensitivity)).otherwise(
        F.create_map(F.lit("sensitivity"), sensitivity, F.lit("layer"), layer)
    )
    return parts.select(F.concat(F.lit("part-"), number).alias("resource"), tags.alias("tags"))
