"""Market feed messages (arrays of quote and trade events) to ticks and order events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import parse_timestamp, quote_midpoint, quote_volume
from tidemark.functions.once import evaluate_once
from tidemark.sources.messages import ParsedMessages

# Fields of a feed event: text name -> (column, type). Names differ only in case ("T" kind, "t" time),
# so events are read as maps, whose keys are case sensitive.
FEED_FIELDS = {
    "T": ("kind", "string"),
    "S": ("symbol", "string"),
    "t": ("time", "string"),
    "bp": ("bid", "decimal(18,6)"),
    "ap": ("ask", "decimal(18,6)"),
    "bs": ("bid_size", "bigint"),
    "as": ("ask_size", "bigint"),
    "p": ("price", "decimal(18,6)"),
    "s": ("size", "decimal(18,4)"),
    "i": ("trade_id", "bigint"),
}
# What an event of a kind cannot do without.
REQUIRED = {"q": ("symbol", "time", "bid", "ask"), "t": ("symbol", "time", "price", "size")}


def parse_feed(df: DataFrame, value_col: str = "value") -> ParsedMessages:
    """Feed messages as events. A message holding a single object counts as an array of one.

    `valid`: one row per event, of any kind. `quarantine`: the message text and `reason`, one row per event that lacks
    a required field or holds it unreadable, and one per message that is no array of objects. A NULL message is a
    tombstone, and an empty array has no events: neither gives a row.
    """
    text = F.trim(F.col(value_col))
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    once = evaluate_once(F.from_json(listed, "array<map<string,string>>"))
    parsed = df.where(F.col(value_col).isNotNull()).select(F.col(value_col).alias("value"), once.alias("__list"))
    filled = F.when(F.col("__list").isNull() | (F.size("__list") > 0), F.coalesce("__list", F.array(F.lit(None))))
    events = parsed.select("value", F.explode(filled).alias("e")).select(
        "value",
        F.col("e").isNull().alias("__broken"),
        *[F.col("e")[name].try_cast(kind).alias(column) for name, (column, kind) in FEED_FIELDS.items()],
    )
    reason = F.when(F.col("__broken"), "malformed").when(F.col("kind").isNull(), "kind is missing")
    for kind, columns in REQUIRED.items():
        for column in columns:
            value = parse_timestamp(column) if column == "time" else F.col(column)
            reason = reason.when((F.col("kind") == kind) & value.isNull(), f"{column} is missing or unreadable")
    return ParsedMessages(
        events.where(reason.isNull()).drop("value", "__broken"),
        events.where(reason.isNotNull()).select("value", reason.alias("reason")),
    )


def feed_events(df: DataFrame, value_col: str = "value") -> DataFrame:
    """The valid events of `parse_feed`."""
    return parse_feed(df, value_col).valid


def _known_symbols(events: DataFrame, instruments: DataFrame) -> DataFrame:
    """Events of unknown symbols drop out. Spark broadcasts the instruments while they are small."""
    symbols = instruments.select(F.col("ticker").alias("symbol"), "instrument_id")
    return events.join(symbols, "symbol", "inner")


def _natural_id(*columns: str) -> F.Column:
    """Repeatable id from the event's own content: a replayed message gets the same id."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def quotes_to_ticks(df: DataFrame, instruments: DataFrame, value_col: str = "value") -> DataFrame:
    """Quote events as market ticks; the last price is the mid of bid and ask."""
    quotes = _known_symbols(feed_events(df, value_col).where(F.col("kind") == "q"), instruments)
    return quotes.select(
        _natural_id("symbol", "time", "bid", "ask", "bid_size", "ask_size").alias("tick_id"),
        "instrument_id",
        F.col("symbol").alias("ticker"),
        "bid",
        "ask",
        quote_midpoint(F.col("bid"), F.col("ask")).alias("last_price"),
        quote_volume(F.col("bid_size"), F.col("ask_size")).alias("volume"),
        parse_timestamp("time").alias("timestamp"),
    )


def trades_to_orders(df: DataFrame, instruments: DataFrame, account_id: int, value_col: str = "value") -> DataFrame:
    """Trade events as order events of one account.

    The side is taken from the id's hash, so it is evenly split and the same on every replay.
    """
    trades = _known_symbols(feed_events(df, value_col).where(F.col("kind") == "t"), instruments)
    identified = trades.withColumn("event_id", _natural_id("symbol", "time", "trade_id", "price", "size"))
    return identified.select(
        "event_id",
        F.lit("ORDER_CREATED").alias("event_type"),
        F.pmod(F.coalesce("trade_id", F.lit(0)), F.lit(1_000_000)).alias("order_id"),
        F.lit(account_id).cast("bigint").alias("account_id"),
        "instrument_id",
        F.col("symbol").alias("ticker"),
        F.when(F.substring("event_id", 1, 1) < "8", "BUY").otherwise("SELL").alias("side"),
        F.col("size").alias("quantity"),
        F.col("price").alias("limit_price"),
        parse_timestamp("time").alias("timestamp"),
    )
