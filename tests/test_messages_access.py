import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.model import GRANTS, MESSAGE_CONTRACTS, ORDERS, TABLE_CONTRACTS, TICK_MESSAGE, TOPIC_ROUTES, Route
from tidemark.operators import access, contracts, routing
from tidemark.operators.cdc import unwrap_cdc
from tidemark.operators.quality import QualityError, freshness, no_nulls, not_empty, quality_gate, row_counts
from tidemark.sources.audit import parse_audit, read_audit_log
from tidemark.sources.feed import parse_feed, quotes_to_ticks, trades_to_orders
from tidemark.sources.messages import parse_messages


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, value string")


# ------------------------------------------------------------------------------------- messages


def test_bare_wrapped_broken_and_tombstone_messages(spark):
    tick = {"tick_id": "t1", "ticker": "AAPL", "bid": "1.0"}
    parsed = parse_messages(
        texts(
            spark,
            json.dumps(tick),
            json.dumps({"schema": {"type": "struct"}, "payload": tick}),
            "{broken",
            json.dumps({"something": "else"}),
            None,
        ),
        TICK_MESSAGE,
    )
    assert rows(parsed.valid, "n", "tick_id", "bid") == [(0, "t1", "1.0"), (1, "t1", "1.0")]
    assert rows(parsed.quarantine, "n", "reason") == [(2, "malformed"), (3, "no known field")]


def test_messages_are_parsed_once(spark):
    parsed = parse_messages(texts(spark, "{}"), TICK_MESSAGE)
    plan = parsed.valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_unwrap_both_variants(spark):
    image = {"order_id": "1", "status": "FILLED"}
    values = [
        json.dumps({"op": "r", "before": None, "after": image, "source_timestamp": 1000}),
        json.dumps({"op": "d", "before": image, "after": None, "source_timestamp": 2000}),
    ]
    events = parse_messages(texts(spark, *values), ORDERS.envelope_schema()).valid
    tagged = unwrap_cdc(events, ["order_id", "status"], "order_id", target="raw_mnpi.orders")
    assert rows(tagged, "n", "status", "_cdc.op", "_cdc.key", "_cdc.target") == [
        (0, "FILLED", "r", "1", "raw_mnpi.orders"),
        (1, "FILLED", "d", "1", "raw_mnpi.orders"),
    ]
    dropped = unwrap_cdc(events, ["order_id", "status"], "order_id", deletes="drop")
    assert dropped.columns == ["n", "order_id", "status"] and rows(dropped, "n") == [(0,)]


# -------------------------------------------------------------------------------------- routing


def test_routing_matches_whole_names_and_partitions_rows(spark):
    topics = [
        "cdc.trading.orders",
        "cdc.trading.orders.dlq",
        "xcdc.trading.orders",
        "stream.market-data",
        "streamXmarket-data",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in topics], "_topic string")
    assert rows(routing.route(df), "table", "zone") == [
        ("raw_mnpi.orders", "mnpi"),
        ("raw_nonmnpi.market_data", "nonmnpi"),
    ]
    assert routing.unrouted(df).count() == 4


def test_a_row_goes_to_every_matching_table(spark):
    routes = [Route("a", "mnpi", "t.*"), Route("b", "mnpi", "topic")]
    df = spark.createDataFrame([("topic",)], "_topic string")
    assert rows(routing.route(df, routes), "table") == [("a",), ("b",)]


def test_no_table_gets_two_zones():
    routing.check_zones(TOPIC_ROUTES)
    with pytest.raises(routing.ZoneConflictError):
        routing.check_zones([Route("a", "mnpi", "x"), Route("a", "nonmnpi", "y")])


def test_short_topic(spark):
    df = spark.createDataFrame([("cdc.trading.public.orders",), ("stream.market-data",)], "t string")
    assert rows(df.select(routing.short_topic(F.col("t")))) == [("cdc.trading.orders",), ("stream.market-data",)]


# ----------------------------------------------------------------------------------------- feed


@pytest.fixture
def symbols(spark):
    return spark.createDataFrame([(1, "QXN"), (2, "RDL")], "instrument_id int, ticker string")


QUOTE = {"T": "q", "S": "QXN", "bp": 41.20, "ap": 41.30, "bs": 70, "as": 35, "t": "2025-11-04T09:12:44Z"}
TRADE = {"T": "t", "S": "QXN", "p": 41.27, "s": 260, "i": 31415, "t": "2025-11-04T09:12:46Z"}


def test_feed_quarantine(spark):
    no_bid = {k: v for k, v in QUOTE.items() if k != "bp"}
    bad_price, no_kind = {**TRADE, "p": "much"}, {"S": "QXN"}
    values = [json.dumps(v) for v in ([QUOTE, no_bid], bad_price, no_kind, [], {"T": "success"})]
    parsed = parse_feed(texts(spark, *values, None, "[{", "plain", "", "[null]"))
    assert rows(parsed.valid, "kind") == [("q",), ("success",)]
    assert rows(parsed.quarantine, "reason") == [
        *[("bid is missing or unreadable",), ("kind is missing",)],
        *[("malformed",)] * 4,
        ("price is missing or unreadable",),
    ]


def test_quotes(spark, symbols):
    messages = texts(
        spark,
        json.dumps([QUOTE, TRADE, {**QUOTE, "S": "UNKNOWN"}]),
        json.dumps({**QUOTE, "S": "RDL", "bp": 7.00, "ap": 7.03, "as": None}),
    )
    ticks = quotes_to_ticks(messages, symbols)
    found = ticks.select("instrument_id", *[F.col(c).cast("double") for c in ("bid", "ask", "last_price")], "volume")
    assert rows(found) == [(1, 41.2, 41.3, 41.25, 105), (2, 7.0, 7.03, 7.02, 70)]
    assert rows(ticks, "tick_id") == rows(quotes_to_ticks(messages.repartition(2), symbols), "tick_id")


def test_trades(spark, symbols):
    big = {**TRADE, "i": 2_031_415}
    orders = trades_to_orders(texts(spark, json.dumps([TRADE, QUOTE, big, {**TRADE, "S": "?"}])), symbols, 7)
    found = orders.select("event_type", "order_id", "account_id", F.col("quantity").cast("int"), F.col("limit_price").cast("double"))
    assert rows(found) == [("ORDER_CREATED", 31415, 7, 260, 41.27)] * 2
    assert set(r.side for r in orders.collect()) <= {"BUY", "SELL"}


# ------------------------------------------------------------------------------------ contracts


ORDER = {
    "order_id": "mx-77",
    "instrument_id": "bond-9",
    "account_id": "fund-3",
    "side": "SELL",
    "order_type": "STOP",
    "quantity": 12.75,
    "price": 88.125,
    "status": "PARTIALLY_FILLED",
    "timestamp_ms": 1767225600000,
}
TICK = {
    "instrument_id": "etf-4",
    "symbol": "ZZQ",
    "bid_price": 31,
    "ask_price": 31.5,
    "last_price": 31.25,
    "volume": 640,
    "timestamp_ms": 1767225600000,
}


@pytest.mark.parametrize(
    ("contract", "record", "expected"),
    [
        ("order-events", ORDER, []),
        ("order-events", {k: v for k, v in ORDER.items() if k != "price"}, []),
        ("order-events", {**ORDER, "order_type": "ICEBERG"}, ["order_type: not allowed"]),
        ("order-events", {k: v for k, v in ORDER.items() if k not in ("account_id", "status")}, ["account_id: missing", "status: missing"]),
        ("order-events", {**ORDER, "price": "cheap"}, ["price: not a double"]),
        ("order-events", {**ORDER, "timestamp_ms": "1767225600000"}, ["timestamp_ms: not a bigint"]),
        ("order-events", {**ORDER, "instrument_id": 5}, ["instrument_id: not a string"]),
        ("order-events", {**ORDER, "side": None}, ["side: missing"]),
        ("order-events", {**ORDER, "desk": {"floor": 2}}, []),
        ("market-data", TICK, []),
        ("market-data", {**TICK, "ask_price": None, "last_price": True}, ["ask_price: missing", "last_price: not a double"]),
        ("market-data", {**TICK, "timestamp_ms": 0.5}, ["timestamp_ms: not a bigint"]),
        ("market-data", [TICK], ["record: malformed"]),
    ],
)
def test_message_contracts(spark, contract, record, expected):
    tagged = contracts.tag_message_violations(texts(spark, json.dumps(record)), MESSAGE_CONTRACTS[contract])
    assert tagged.first()["violations"] == expected


def test_records_are_parsed_once_even_when_split(spark):
    tagged = contracts.tag_message_violations(texts(spark, "{}"), MESSAGE_CONTRACTS["market-data"])
    for part in contracts.split_valid(tagged):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_broken_and_missing_records(spark):
    tagged = contracts.tag_message_violations(texts(spark, "{oops", None), MESSAGE_CONTRACTS["market-data"])
    assert rows(tagged, "violations") == [(["record: malformed"],), (["record: malformed"],)]


def test_table_contract_split(spark):
    good = {"account_id": 1, "account_name": "A", "account_type": "FUND", "status": "ACTIVE", "created_at": "2026-01-01T00:00:00Z"}
    bad = {**good, "account_type": "HEDGE", "created_at": "soon", "account_name": None}
    df = spark.createDataFrame([good, bad], "account_id int, account_name string, account_type string, status string, created_at string")
    valid, quarantine = contracts.check_contract(df, TABLE_CONTRACTS["accounts"])
    assert valid.count() == 1 and valid.columns == df.columns
    assert rows(quarantine, "violations") == [
        (["account_name: missing", "account_type: not allowed", "created_at: not a timestamp"],)
    ]


def test_duplicates_and_orphans(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (None, "a")], "id int, v string")
    assert rows(contracts.find_duplicates(df, ["id", "v"])) == [(1, "a", 2)]
    parent = spark.createDataFrame([(1,)], "pk int")
    assert rows(contracts.find_orphans(df, "id", parent, "pk"), "id") == [(2,)]


# -------------------------------------------------------------------------------------- quality


def test_gate_raises_on_the_first_failing_check_and_runs_one_job(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    with pytest.raises(QualityError, match="no null k"):
        quality_gate(df, "t", {**not_empty(), **no_nulls("k")})
    assert quality_gate(df.where("k is not null"), "t", {**not_empty(), **no_nulls("k")})["row_count"] == 1
    with pytest.raises(QualityError, match="row_count > 0"):
        quality_gate(df.where("false"), "t", not_empty())


def test_counts_and_freshness(spark):
    assert rows(row_counts({"a": spark.range(3), "b": spark.range(0)})) == [("a", 3), ("b", 0)]
    ledger = spark.sql("SELECT timestamp'2026-01-01 00:00:00' committed_at")
    assert rows(freshness({"a": ledger}, F.lit("2026-01-01 00:02:00")), "lag_seconds") == [(120,)]


# --------------------------------------------------------------------------------------- access


EXPECTED = {
    "raw_mnpi": ("DENIED", "DENIED", "ALL"),
    "raw_nonmnpi": ("DENIED", "DENIED", "ALL"),
    "curated_mnpi": ("SELECT", "DENIED", "ALL"),
    "curated_nonmnpi": ("SELECT", "SELECT", "ALL"),
    "analytics_mnpi": ("SELECT", "DENIED", "ALL"),
    "analytics_nonmnpi": ("SELECT", "SELECT", "ALL"),
}
PERSONAS = ("finance-analyst", "data-analyst", "data-engineer")


def test_access_matrix(spark):
    databases = access.standard_databases(spark)
    matrix = {(r.resource, r.principal): r.permission for r in access.access_matrix(databases).collect()}
    assert matrix == {(db, p): right for db, line in EXPECTED.items() for p, right in zip(PERSONAS, line)}
    tags = {r.resource: r.tags for r in databases.collect()}
    assert all(access.permission(p, tags[db], GRANTS) == right for (db, p), right in matrix.items())


def test_matrix_needs_no_shuffle_and_agrees_with_the_grants(spark):
    databases = access.standard_databases(spark)
    matrix = access.access_matrix(databases)
    assert "Exchange" not in matrix._jdf.queryExecution().executedPlan().toString()
    allowed = matrix.where("permission != 'DENIED'")
    assert rows(access.satisfied_grants(databases)) == rows(allowed)


def test_resource_without_a_tag_is_denied(spark):
    bare = spark.sql("SELECT 'r' AS resource, map('sensitivity', 'mnpi') AS tags")
    assert rows(access.access_matrix(bare), "permission") == [("DENIED",)] * 3


def test_new_tables_inherit_tags(spark):
    tables = spark.createDataFrame([("curated_mnpi.new", "curated_mnpi")], "table string, database string")
    inherited = access.inherit_tags(tables, access.standard_databases(spark))
    assert rows(access.access_matrix(inherited).where("permission != 'DENIED'"), "principal", "permission") == [
        ("data-engineer", "ALL"),
        ("finance-analyst", "SELECT"),
    ]


def test_audit_log_from_files_and_text(spark, tmp_path):
    record = {
        "useridentity": {"type": "user", "username": "data-analyst"},
        "eventtime": "2026-03-02T10:15:00Z",
        "eventname": "GetObject",
        "resources": [{"arn": "curated_mnpi"}, {"arn": "curated_nonmnpi"}],
        "requestid": "ignored",
    }
    (tmp_path / "log.json").write_text(json.dumps(record) + "\n" + json.dumps(record) + "\n")
    matrix = access.access_matrix(access.standard_databases(spark))
    for records in (read_audit_log(spark, str(tmp_path)), parse_audit(texts(spark, *[json.dumps(record)] * 2))):
        report = access.audit_report(records, matrix)
        assert rows(report, "resource", "accesses", "permission", "outside_policy") == [
            ("curated_mnpi", 2, "DENIED", True),
            ("curated_nonmnpi", 2, "SELECT", False),
        ]


def test_denied_read_is_an_error_not_an_empty_result(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS curated_mnpi")
    spark.range(2).write.mode("overwrite").saveAsTable("curated_mnpi.orders")
    assert access.read_as(spark, "finance-analyst", "curated", "mnpi", "orders").count() == 2
    with pytest.raises(access.AccessDenied):
        access.read_as(spark, "data-analyst", "curated", "mnpi", "orders")
    with pytest.raises(access.AccessDenied):  # denied even where the table is missing
        access.read_as(spark, "data-analyst", "raw", "mnpi", "nothing")
    spark.sql("DROP DATABASE curated_mnpi CASCADE")
