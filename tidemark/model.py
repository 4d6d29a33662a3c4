"""Data model: trading entities, message shapes, topic routes, contracts and access tags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LAYERS = ("raw", "curated", "analytics")
ZONES = ("mnpi", "nonmnpi")


def database_name(layer: str, zone: str) -> str:
    if layer not in LAYERS or zone not in ZONES:
        raise ValueError(f"unknown layer or zone: {layer}, {zone}")
    return f"{layer}_{zone}"


@dataclass(frozen=True)
class Entity:
    """A source table as it arrives through the change log.

    `columns` are read from the row image. `event_time_on_insert` columns are set once, from the time
    of the change event; `event_time` columns are set from it on every merge.
    """

    name: str
    zone: str
    key: str
    columns: dict[str, str]
    event_time_on_insert: tuple[str, ...] = ()
    event_time: tuple[str, ...] = ()

    @property
    def output_columns(self) -> dict[str, str]:
        stamped = {name: "timestamp" for name in (*self.event_time_on_insert, *self.event_time)}
        return {**self.columns, **stamped}

    def image_schema(self) -> T.StructType:
        """Row image as it arrives: every value as text."""
        names = [*self.columns, *(n for n in self.event_time_on_insert + self.event_time if n not in self.columns)]
        return T.StructType([T.StructField(name, T.StringType()) for name in names])

    def envelope_schema(self) -> T.StructType:
        image = self.image_schema()
        return T.StructType(
            [
                T.StructField("op", T.StringType()),
                T.StructField("before", image),
                T.StructField("after", image),
                T.StructField("source_timestamp", T.LongType()),
            ]
        )


ORDERS = Entity(
    name="orders",
    zone="mnpi",
    key="order_id",
    columns={
        "order_id": "bigint",
        "account_id": "bigint",
        "instrument_id": "bigint",
        "side": "string",
        "quantity": "decimal(18,4)",
        "order_type": "string",
        "limit_price": "decimal(18,4)",
        "status": "string",
        "disclosure_status": "string",
    },
    event_time_on_insert=("created_at",),
    event_time=("updated_at",),
)
TRADES = Entity(
    name="trades",
    zone="mnpi",
    key="trade_id",
    columns={
        "trade_id": "bigint",
        "order_id": "bigint",
        "instrument_id": "bigint",
        "quantity": "decimal(18,4)",
        "price": "decimal(18,4)",
        "execution_venue": "string",
        "settlement_date": "date",
        "disclosure_status": "string",
        "executed_at": "timestamp",
    },
    event_time=("updated_at",),
)
POSITIONS = Entity(
    name="positions",
    zone="mnpi",
    key="position_id",
    columns={
        "position_id": "bigint",
        "account_id": "bigint",
        "instrument_id": "bigint",
        "quantity": "decimal(18,4)",
        "market_value": "decimal(18,2)",
        "position_date": "date",
    },
    event_time=("updated_at",),
)
ACCOUNTS = Entity(
    name="accounts",
    zone="nonmnpi",
    key="account_id",
    columns={
        "account_id": "bigint",
        "account_name": "string",
        "account_type": "string",
        "status": "string",
        "created_at": "timestamp",
    },
)
INSTRUMENTS = Entity(
    name="instruments",
    zone="nonmnpi",
    key="instrument_id",
    columns={
        "instrument_id": "bigint",
        "ticker": "string",
        "cusip": "string",
        "isin": "string",
        "name": "string",
        "instrument_type": "string",
        "exchange": "string",
        "created_at": "timestamp",
    },
)
ENTITIES = {e.name: e for e in (ORDERS, TRADES, POSITIONS, ACCOUNTS, INSTRUMENTS)}

TICK_MESSAGE = T.StructType(
    [
        T.StructField("tick_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("bid", T.StringType()),
        T.StructField("ask", T.StringType()),
        T.StructField("last_price", T.StringType()),
        T.StructField("volume", T.StringType()),
        T.StructField("instrument_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Route:
    """Topics whose whole name matches `pattern` are appended to `table`."""

    table: str
    zone: str
    pattern: str


# Topics, tables and zones of the trading platform.
TOPIC_ROUTES = (
    Route("raw_mnpi.orders", "mnpi", r"cdc\.trading\.orders"),
    Route("raw_mnpi.trades", "mnpi", r"cdc\.trading\.trades"),
    Route("raw_mnpi.positions", "mnpi", r"cdc\.trading\.positions"),
    Route("raw_nonmnpi.accounts", "nonmnpi", r"cdc\.trading\.accounts"),
    Route("raw_nonmnpi.instruments", "nonmnpi", r"cdc\.trading\.instruments"),
    Route("raw_nonmnpi.market_data", "nonmnpi", r"stream\.market-data"),
)


@dataclass(frozen=True)
class FieldRule:
    """One column of a contract. `kind` is a Spark type name the value must be readable as."""

    name: str
    kind: str = "string"
    required: bool = True
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[FieldRule, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str, str], ...] = field(default=())
    """(column, referenced table, referenced column)"""


# Allowed codes of the source tables.
SIDES = ("BUY", "SELL")
ORDER_TYPES = ("MARKET", "LIMIT", "STOP")
ORDER_STATUSES = ("PENDING", "FILLED", "PARTIAL", "CANCELLED")
DISCLOSURE_STATUSES = ("MNPI", "DISCLOSED", "PUBLIC")
ACCOUNT_TYPES = ("INDIVIDUAL", "INSTITUTIONAL", "FUND")
ACCOUNT_STATUSES = ("ACTIVE", "SUSPENDED", "CLOSED")
INSTRUMENT_TYPES = ("EQUITY", "BOND", "ETF", "OPTION")

TABLE_CONTRACTS = {
    "orders": Contract(
        "orders",
        (
            FieldRule("order_id", "bigint"),
            FieldRule("account_id", "bigint"),
            FieldRule("instrument_id", "bigint"),
            FieldRule("side", allowed=SIDES),
            FieldRule("quantity", "decimal(18,4)"),
            FieldRule("order_type", allowed=ORDER_TYPES),
            FieldRule("limit_price", "decimal(18,4)", required=False),
            FieldRule("status", allowed=ORDER_STATUSES),
            FieldRule("disclosure_status", allowed=DISCLOSURE_STATUSES),
            FieldRule("created_at", "timestamp"),
            FieldRule("updated_at", "timestamp"),
        ),
        unique=(("order_id",),),
        references=(("account_id", "accounts", "account_id"), ("instrument_id", "instruments", "instrument_id")),
    ),
    "trades": Contract(
        "trades",
        (
            FieldRule("trade_id", "bigint"),
            FieldRule("order_id", "bigint"),
            FieldRule("instrument_id", "bigint"),
            FieldRule("quantity", "decimal(18,4)"),
            FieldRule("price", "decimal(18,4)"),
            FieldRule("execution_venue"),
            FieldRule("settlement_date", "date", required=False),
            FieldRule("disclosure_status", allowed=DISCLOSURE_STATUSES),
            FieldRule("executed_at", "timestamp"),
            FieldRule("updated_at", "timestamp"),
        ),
        unique=(("trade_id",),),
        references=(("order_id", "orders", "order_id"), ("instrument_id", "instruments", "instrument_id")),
    ),
    "positions": Contract(
        "positions",
        (
            FieldRule("position_id", "bigint"),
            FieldRule("account_id", "bigint"),
            FieldRule("instrument_id", "bigint"),
            FieldRule("quantity", "decimal(18,4)"),
            FieldRule("market_value", "decimal(18,2)", required=False),
            FieldRule("position_date", "date"),
            FieldRule("updated_at", "timestamp"),
        ),
        unique=(("position_id",), ("account_id", "instrument_id", "position_date")),
        references=(("account_id", "accounts", "account_id"), ("instrument_id", "instruments", "instrument_id")),
    ),
    "accounts": Contract(
        "accounts",
        (
            FieldRule("account_id", "bigint"),
            FieldRule("account_name"),
            FieldRule("account_type", allowed=ACCOUNT_TYPES),
            FieldRule("status", allowed=ACCOUNT_STATUSES),
            FieldRule("created_at", "timestamp"),
        ),
        unique=(("account_id",),),
    ),
    "instruments": Contract(
        "instruments",
        (
            FieldRule("instrument_id", "bigint"),
            FieldRule("ticker"),
            FieldRule("cusip", required=False),
            FieldRule("isin", required=False),
            FieldRule("name"),
            FieldRule("instrument_type", allowed=INSTRUMENT_TYPES),
            FieldRule("exchange"),
            FieldRule("created_at", "timestamp"),
        ),
        unique=(("instrument_id",), ("ticker",)),
    ),
}

# Message contracts: the record schemas producers register. Status codes differ from the tables'.
MESSAGE_CONTRACTS = {
    "order-events": Contract(
        "order-events",
        (
            FieldRule("order_id"),
            FieldRule("instrument_id"),
            FieldRule("account_id"),
            FieldRule("side", allowed=SIDES),
            FieldRule("order_type", allowed=ORDER_TYPES),
            FieldRule("quantity", "double"),
            FieldRule("price", "double", required=False),
            FieldRule("status", allowed=("NEW", "FILLED", "PARTIALLY_FILLED", "CANCELLED")),
            FieldRule("timestamp_ms", "bigint"),
        ),
    ),
    "market-data": Contract(
        "market-data",
        (
            FieldRule("instrument_id"),
            FieldRule("symbol"),
            FieldRule("bid_price", "double"),
            FieldRule("ask_price", "double"),
            FieldRule("last_price", "double"),
            FieldRule("volume", "bigint"),
            FieldRule("timestamp_ms", "bigint"),
        ),
    ),
}


@dataclass(frozen=True)
class Grant:
    """A right for every resource whose tags satisfy all expressions (any listed value per key)."""

    principal: str
    permission: str
    expressions: dict[str, tuple[str, ...]]


# Sensitivity tag of each zone, and the three personas' grants.
ZONE_SENSITIVITY = {"mnpi": "mnpi", "nonmnpi": "non-mnpi"}
GRANTS = (
    Grant(
        "finance-analyst",
        "SELECT",
        {"sensitivity": ("mnpi", "non-mnpi"), "layer": ("curated", "analytics")},
    ),
    Grant("data-analyst", "SELECT", {"sensitivity": ("non-mnpi",), "layer": ("curated", "analytics")}),
    Grant(
        "data-engineer",
        "ALL",
        {"sensitivity": ("mnpi", "non-mnpi"), "layer": ("raw", "curated", "analytics")},
    ),
)

# Format of the audit log.
AUDIT_RECORD = """
    eventversion string,
    useridentity struct<
        type: string, principalid: string, arn: string, accountid: string,
        invokedby: string, accesskeyid: string, username: string,
        sessioncontext: struct<
            attributes: struct<mfaauthenticated: string, creationdate: string>,
            sessionissuer: struct<type: string, principalid: string, arn: string,
                                  accountid: string, username: string>,
            ec2roledelivery: string,
            webidfederationdata: struct<federatedprovider: string, attributes: string>>>,
    eventtime string, eventsource string, eventname string, awsregion string,
    sourceipaddress string, useragent string, errorcode string, errormessage string,
    requestparameters string, responseelements string, additionaleventdata string,
    requestid string, eventid string, eventtype string, recipientaccountid string,
    sharedeventid string, readonly string,
    resources array<struct<arn: string, accountid: string, type: string>>
"""
