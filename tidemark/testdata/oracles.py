"""The same queries in DuckDB SQL, written from the semantics and independent of the Spark code."""

from __future__ import annotations

# ------------------------------------------------------------------------------- shared WITH parts

RAW_TICKS = """
raw_ticks AS (
  SELECT event_id,
    concat('t', CASE WHEN event_id % 5 = 4 THEN event_id - 4 ELSE event_id END) AS tick_id,
    CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 51 = 0 THEN NULL ELSE upper(event_type) END AS ticker,
    cast(value AS decimal(18,2)) AS price,
    cast(cast(cast(value AS decimal(18,2)) - 0.05 AS decimal(18,2)) AS double) AS bid,
    cast(cast(cast(value AS decimal(18,2)) + 0.05 AS decimal(18,2)) AS double) AS ask,
    cast(json_extract_string(props, '$.k') AS bigint) AS volume,
    user_id AS instrument_id, ts,
    CASE WHEN event_id % 7 = 0 THEN least((day(ts) - 1) // 8 + 2, 4) ELSE (day(ts) - 1) // 8 + 1 END AS batch
  FROM events)"""


def ticks_cte(name: str = "ticks", where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT tick_id, ticker, bid, ask, cast(price AS double) AS last_price, volume, instrument_id,
    ts AS tick_timestamp, ask - bid AS spread, (ask + bid) / 2.0 AS mid_price,
    date_trunc('hour', ts) AS tick_hour, event_id
  FROM raw_ticks WHERE ticker IS NOT NULL AND ticker <> '' AND {where}
  QUALIFY row_number() OVER (PARTITION BY tick_id ORDER BY ts DESC, event_id DESC) = 1)"""


TICKS = RAW_TICKS + "," + ticks_cte()
TICK_COLUMNS = (
    "tick_id, ticker, bid, ask, last_price, volume, instrument_id, tick_timestamp, spread, mid_price, tick_hour"
)


def rounded(expression: str, digits: int) -> str:
    return f"cast(round(cast({expression} AS decimal(38,10)), {digits}) AS double)"


MARKET = f"""
    count(*) AS tick_count, cast(sum(volume) AS bigint) AS total_volume,
    {rounded("min(last_price)", 2)} AS low_price, {rounded("max(last_price)", 2)} AS high_price,
    {rounded("avg(last_price)", 2)} AS avg_price, {rounded("avg(spread)", 4)} AS avg_spread,
    {rounded("avg(mid_price)", 2)} AS avg_mid_price,
    {rounded("avg(spread) / nullif(avg(mid_price), 0) * 100", 4)} AS spread_pct,
    min(tick_timestamp) AS first_tick_at, max(tick_timestamp) AS last_tick_at"""
OPEN_CLOSE = f"""
    {rounded("arg_min(last_price, tick_timestamp)", 2)} AS open_price,
    {rounded("arg_max(last_price, tick_timestamp)", 2)} AS close_price"""

ORDER_LOG = """
base AS (SELECT *, o_orderdate + to_hours(cast(o_orderkey % 24 AS integer)) AS created FROM orders),
order_steps AS (
  SELECT *, 'c' AS op, 1 AS seq, created AS happened FROM base
  UNION ALL SELECT *, 'u', 2, created + interval 1 hour FROM base WHERE o_orderstatus IN ('F', 'P')
  UNION ALL SELECT *, 'd', 3, created + interval 2 hour FROM base WHERE o_orderkey % 97 = 0),
order_log AS (
  SELECT o_orderkey AS order_id, o_custkey AS account_id, o_orderkey % 50 AS instrument_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    cast(o_totalprice AS decimal(18,4)) AS quantity,
    CASE WHEN o_orderkey % 3 = 0 THEN 'LIMIT' ELSE 'MARKET' END AS order_type,
    CASE WHEN o_orderkey % 3 = 0 THEN cast(o_totalprice / 100 AS decimal(18,4)) END AS limit_price,
    CASE WHEN seq = 1 THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'FILLED'
         WHEN o_orderstatus = 'P' THEN 'PARTIAL' ELSE 'PENDING' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN 'DISCLOSED' ELSE 'MNPI' END AS disclosure_status,
    created AS created_at, happened AS updated_at, op, seq, o_orderkey * 4 + seq AS log_offset
  FROM order_steps)"""

ORDER_EVENTS = (
    ORDER_LOG
    + """,
order_events AS (
  SELECT order_id, account_id, instrument_id, side, order_type, cast(trunc(quantity) AS bigint) AS quantity,
    cast(limit_price AS double) AS limit_price, status, disclosure_status, created_at, updated_at,
    side = 'BUY' AS is_buy, date_trunc('hour', created_at) AS order_hour
  FROM order_log WHERE op <> 'd'
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, seq DESC) = 1)"""
)

ORDER_MEASURES = f"""
    count(*) AS total_orders, count(CASE WHEN is_buy THEN 1 END) AS buy_orders,
    count(CASE WHEN NOT is_buy THEN 1 END) AS sell_orders, cast(sum(quantity) AS bigint) AS total_volume,
    cast({rounded("avg(quantity)", 0)} AS bigint) AS avg_order_size,
    {rounded("count(CASE WHEN is_buy THEN 1 END)::double / nullif(count(CASE WHEN NOT is_buy THEN 1 END), 0)", 2)}
      AS buy_sell_ratio,
    min(created_at) AS first_order_at, max(created_at) AS last_order_at"""

CURRENT_ORDERS = (
    ORDER_LOG
    + """,
current_orders AS (
  SELECT * FROM order_log WHERE op <> 'd'
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, seq DESC) = 1)"""
)

TRADE_LOG = """
trade_log AS (
  SELECT l_orderkey * 8 + l_linenumber AS trade_id, l_orderkey AS order_id, l_partkey AS instrument_id,
    cast(l_quantity AS decimal(18,4)) AS quantity, cast(l_extendedprice AS decimal(18,4)) AS price,
    CASE l_returnflag WHEN 'A' THEN 'NYSE' WHEN 'N' THEN 'NASDAQ' ELSE 'ARCA' END AS execution_venue,
    cast(l_shipdate AS date) + 2 AS settlement_date,
    CASE WHEN l_linestatus = 'F' THEN 'DISCLOSED' ELSE 'MNPI' END AS disclosure_status,
    l_shipdate + to_hours(l_linenumber) AS executed_at,
    CASE WHEN year(l_shipdate) < 1999 THEN 1 ELSE 2 END AS batch,
    concat_ws('|', cast(l_extendedprice AS decimal(18,4)), cast(l_quantity AS decimal(18,4)), l_partkey,
              l_returnflag, l_linestatus) AS log_position
  FROM lineitem)"""


def newest_trades(name: str, where: str = "true") -> str:
    return f"""
{name} AS (SELECT * FROM trade_log WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY executed_at DESC, log_position DESC) = 1)"""


TRADES = TRADE_LOG + "," + newest_trades("trades")

ACCOUNTS = """
accounts AS (
  SELECT c_custkey AS account_id, c_name AS account_name,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'INDIVIDUAL' WHEN 'MACHINERY' THEN 'FUND'
         ELSE 'INSTITUTIONAL' END AS account_type,
    CASE WHEN c_custkey % 10 = 0 THEN 'CLOSED' WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
    TIMESTAMP '2024-01-01' + to_days(c_nationkey) AS created_at
  FROM customer)"""

INSTRUMENTS = """
instruments AS (
  SELECT p_partkey AS instrument_id, concat('T', p_partkey) AS ticker,
    lpad(cast(p_partkey AS varchar), 9, '0') AS cusip,
    concat('US', lpad(cast(p_partkey AS varchar), 10, '0')) AS isin,
    CASE WHEN p_partkey % 20 = 0 THEN p_name || ' (new)' ELSE p_name END AS name,
    CASE p_size % 4 WHEN 0 THEN 'EQUITY' WHEN 1 THEN 'BOND' WHEN 2 THEN 'ETF' ELSE 'OPTION' END AS instrument_type,
    CASE WHEN p_size % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
    TIMESTAMP '2024-01-01' AS created_at
  FROM part)"""

POSITIONS = (
    CURRENT_ORDERS
    + ","
    + TRADES
    + """,
positions AS (
  SELECT o.account_id, t.instrument_id, cast(t.executed_at AS date) AS position_date,
    sum(CASE WHEN o.side = 'BUY' THEN t.quantity ELSE -t.quantity END) AS quantity,
    arg_max(t.price, (t.executed_at, t.trade_id)) AS last_price,
    count(*) AS execution_count, max(t.executed_at) AS updated_at,
    arg_max(t.trade_id, (t.executed_at, t.trade_id)) AS last_trade_id
  FROM trades t JOIN current_orders o USING (order_id)
  GROUP BY ALL),
valued AS (SELECT *, round(quantity * last_price, 2) AS market_value FROM positions)"""
)

TRADE_COLUMNS = """trade_id, order_id, instrument_id, cast(quantity AS double) AS quantity,
  cast(price AS double) AS price, execution_venue, cast(settlement_date AS varchar) AS settlement_date,
  disclosure_status, executed_at"""

SUSPECT = (
    ORDER_LOG
    + """,
suspect AS (
  SELECT order_id, op, status, concat_ws('; ',
    CASE WHEN order_id % 11 = 0 THEN 'side: not allowed' END,
    CASE WHEN order_id % 13 = 0 THEN 'quantity: not a decimal(18,4)' END,
    CASE WHEN order_id % 17 = 0 THEN 'status: missing' END) AS violations
  FROM order_log)"""
)

MESSAGES = (
    ORDER_LOG
    + """,
messages AS (SELECT * FROM order_log WHERE log_offset % 31 <> 0 AND log_offset % 37 <> 0)"""
)

TOPICS = """
topics AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'cdc.trading.accounts' WHEN 'purchase' THEN 'cdc.trading.orders'
    WHEN 'click' THEN 'cdc.trading.trades' WHEN 'view' THEN 'stream.market-data'
    ELSE 'stream.market-data-dlq' END AS _topic
  FROM events),
routed AS (
  SELECT *, CASE WHEN regexp_full_match(_topic, 'cdc\\.trading\\.(orders|trades|positions)')
                 THEN 'raw_mnpi.' || regexp_extract(_topic, '[a-z]+$')
                 WHEN regexp_full_match(_topic, 'cdc\\.trading\\.(accounts|instruments)')
                 THEN 'raw_nonmnpi.' || regexp_extract(_topic, '[a-z]+$')
                 WHEN regexp_full_match(_topic, 'stream\\.market-data') THEN 'raw_nonmnpi.market_data' END AS tbl
  FROM topics)"""

FEED = """
feed AS (
  SELECT event_id, concat('T', user_id) AS symbol, cast(value AS decimal(18,2)) AS price,
    cast(json_extract_string(props, '$.k') AS bigint) AS size,
    strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time_text,
    date_trunc('milliseconds', ts) AS time, p_partkey AS instrument_id
  FROM events JOIN part ON p_partkey = user_id WHERE event_id % 9 <> 0)"""

AUDIT = """
audit AS (
  SELECT ['finance-analyst', 'data-analyst', 'data-engineer'][user_id % 3 + 1] AS principal,
    CASE WHEN event_type = 'error' THEN 'PutObject' ELSE 'GetObject' END AS action,
    date_trunc('second', ts) AS accessed_at,
    ['raw_mnpi', 'raw_nonmnpi', 'curated_mnpi', 'curated_nonmnpi', 'analytics_mnpi', 'analytics_nonmnpi']
      [n % 6 + 1] AS resource
  FROM (SELECT *, event_id AS n FROM events
        UNION ALL SELECT *, event_id + 3 FROM events WHERE event_id % 5 = 0))"""

HISTORY = """
history AS (
  SELECT batch AS snapshot_id, max(ts) AS committed_at, 'append' AS operation, count(*) AS added_records
  FROM raw_ticks GROUP BY batch)"""

BY_EVENT = """
raw_orders AS (
  SELECT tick_id AS event_id, CASE WHEN event_id % 40 = 0 THEN '' ELSE 'ORDER_CREATED' END AS event_type, ticker,
    CASE WHEN event_id % 2 = 0 THEN 'BUY' WHEN event_id % 3 = 0 THEN 'SELL' END AS side,
    cast(trunc(price) AS bigint) AS quantity, event_id AS order_id, '1' AS account_id, instrument_id,
    ts AS event_timestamp
  FROM raw_ticks),
stream_orders AS (
  SELECT *, side = 'BUY' AS is_buy, date_trunc('hour', event_timestamp) AS event_hour
  FROM raw_orders WHERE ticker <> '' AND event_type <> ''
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_timestamp DESC, order_id DESC) = 1)"""


def merged(log: str, key: str, ties: str, at: str, columns: list[str], fixed: dict[str, str], select: str) -> str:
    """Batch 1 as the target, later batches merged into it; `fixed` columns keep the target's value."""

    def newest(name: str, where: str) -> str:
        return (
            f"{name} AS (SELECT * FROM {log} WHERE op <> 'd' AND {where} "
            f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC{', ' if ties else ''}{ties}) = 1)"
        )

    picked = ", ".join(
        f"CASE WHEN s.{key} IS NULL OR (t.{key} IS NOT NULL AND {str(c in fixed).lower()}) "
        f"THEN t.{fixed.get(c, c)} ELSE s.{fixed.get(c, c)} END AS {c}"
        for c in columns
    )
    return f"""{newest("old", "batch = 1")}, {newest("new", "batch > 1")},
merged AS (SELECT {picked} FROM old t FULL OUTER JOIN new s ON t.{key} = s.{key})
SELECT {select} FROM merged"""


# ------------------------------------------------------------------------------------------ queries

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

CURATED_TICKS = f"WITH {TICKS} SELECT {TICK_COLUMNS} FROM ticks"
RAW_ROW = "batch AS snapshot_id, event_id, tick_id, ticker, cast(price AS varchar) AS last_price"

ORACLES: dict[str, str] = {
    "market_ticks_curated": CURATED_TICKS,
    "incremental_equals_full": CURATED_TICKS,
    "stream_curated_ticks": CURATED_TICKS,
    "market_summary_hourly": f"""WITH {TICKS}
SELECT ticker, tick_hour, {MARKET}, {OPEN_CLOSE} FROM ticks GROUP BY ticker, tick_hour""",
    "market_summary_ticker": f"WITH {TICKS} SELECT ticker, {MARKET} FROM ticks GROUP BY ticker",
    "market_rollup_daily": f"""WITH {TICKS}
SELECT ticker, cast(date_trunc('day', tick_timestamp) AS timestamp) AS tick_day, {MARKET}, {OPEN_CLOSE}
FROM ticks GROUP BY 1, 2""",
    "order_events_curated": f"""WITH {ORDER_EVENTS}
SELECT * REPLACE (cast(order_id AS varchar) AS order_id, cast(account_id AS varchar) AS account_id,
  cast(instrument_id AS varchar) AS instrument_id) FROM order_events""",
    "order_stream_curated": f"WITH {RAW_TICKS}, {BY_EVENT} SELECT * FROM stream_orders",
    "order_stream_summary": f"""WITH {RAW_TICKS}, {BY_EVENT}
SELECT ticker, count(*) AS total_orders, count(CASE WHEN is_buy THEN 1 END) AS buy_orders,
  count(CASE WHEN NOT is_buy THEN 1 END) AS sell_orders, cast(sum(quantity) AS bigint) AS total_volume,
  {rounded("avg(quantity)", 0)} AS avg_order_size,
  {rounded("count(CASE WHEN is_buy THEN 1 END)::double / nullif(count(CASE WHEN NOT is_buy THEN 1 END), 0)", 2)}
    AS buy_sell_ratio,
  min(event_timestamp) AS first_order_at, max(event_timestamp) AS last_order_at
FROM stream_orders GROUP BY ticker""",
    "order_summary_hourly": f"""WITH {ORDER_EVENTS}
SELECT cast(instrument_id AS varchar) AS instrument_id, order_hour, {ORDER_MEASURES}
FROM order_events GROUP BY instrument_id, order_hour""",
    "order_summary_instrument": f"""WITH {ORDER_EVENTS}
SELECT cast(instrument_id AS varchar) AS instrument_id, {ORDER_MEASURES}
FROM order_events GROUP BY instrument_id""",
    "order_rollup_daily": f"""WITH {ORDER_EVENTS}
SELECT cast(instrument_id AS varchar) AS instrument_id, cast(date_trunc('day', created_at) AS timestamp) AS order_day,
  {ORDER_MEASURES}
FROM order_events GROUP BY instrument_id, 2""",
    "order_current_state_keep_last": f"""WITH {CURRENT_ORDERS}
SELECT cast(order_id AS varchar) AS order_id, status, side, op AS last_op, updated_at AS changed_at FROM current_orders""",
    "order_current_state_remove": f"""WITH {CURRENT_ORDERS}
SELECT cast(order_id AS varchar) AS order_id, status, side, op AS last_op, updated_at AS changed_at FROM current_orders
WHERE order_id NOT IN (SELECT order_id FROM order_log WHERE op = 'd')""",
    "order_current_state_tombstone": f"""WITH {ORDER_LOG}
SELECT cast(order_id AS varchar) AS order_id, status, side, op AS last_op, updated_at AS changed_at FROM order_log
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, seq DESC) = 1""",
    "merge_orders": f"WITH {ORDER_LOG}, log AS (SELECT *, seq AS batch FROM order_log), "
    + merged(
        "log",
        "order_id",
        "seq DESC",
        "updated_at",
        [
            "order_id",
            "account_id",
            "instrument_id",
            "side",
            "quantity",
            "order_type",
            "limit_price",
            "status",
            "disclosure_status",
            "created_at",
            "updated_at",
        ],
        {"created_at": "updated_at"},
        "* REPLACE (cast(quantity AS double) AS quantity, cast(limit_price AS double) AS limit_price)",
    ),
    "merge_trades": f"WITH {TRADE_LOG}, log AS (SELECT *, 'c' AS op, executed_at AS updated_at FROM trade_log), "
    + merged(
        "log",
        "trade_id",
        "log_position DESC",
        "executed_at",
        [
            "trade_id",
            "order_id",
            "instrument_id",
            "quantity",
            "price",
            "execution_venue",
            "settlement_date",
            "disclosure_status",
            "executed_at",
            "updated_at",
        ],
        {},
        TRADE_COLUMNS + ", updated_at",
    ),
    "merge_positions": """WITH log AS (
  SELECT o_custkey * 50 + o_orderkey % 50 AS position_id, o_custkey AS account_id, o_orderkey % 50 AS instrument_id,
    cast(o_orderkey % 1000 AS double) AS quantity, o_totalprice AS market_value,
    cast(cast(o_orderdate AS date) AS varchar) AS position_date, o_orderdate AS updated_at, o_orderkey,
    CASE WHEN o_orderkey % 89 = 0 THEN 'd' ELSE 'u' END AS op,
    CASE WHEN year(o_orderdate) < 1998 THEN 1 ELSE 2 END AS batch
  FROM orders), """
    + merged(
        "log",
        "position_id",
        "o_orderkey DESC",
        "updated_at",
        ["position_id", "account_id", "instrument_id", "quantity", "market_value", "position_date", "updated_at"],
        {},
        "*",
    ),
    "merge_accounts": f"WITH {ACCOUNTS} SELECT * FROM accounts",
    "current_accounts": f"WITH {ACCOUNTS} SELECT * FROM accounts",
    "merge_instruments": f"WITH {INSTRUMENTS} SELECT * FROM instruments",
    "current_instruments": f"WITH {INSTRUMENTS} SELECT * FROM instruments",
    "current_trades": f"WITH {TRADES} SELECT {TRADE_COLUMNS}, executed_at AS updated_at FROM trades",
    "trade_summary_daily": f"""WITH {TRADES}, {INSTRUMENTS}
SELECT cast(cast(executed_at AS date) AS varchar) AS trade_date, ticker, name AS instrument_name, execution_venue,
  count(*) AS trade_count, cast(sum(quantity) AS double) AS total_quantity,
  cast(cast(sum(cast(quantity AS decimal(18,4)) * price) AS decimal(38,4)) AS double) AS total_notional,
  {rounded("cast(sum(price) AS double) / count(price)", 4)} AS avg_price,
  cast(min(price) AS double) AS min_price, cast(max(price) AS double) AS max_price
FROM trades JOIN instruments USING (instrument_id) GROUP BY 1, 2, 3, 4""",
    "executions_enriched": f"""WITH {CURRENT_ORDERS}, {TRADES}
SELECT trade_id, order_id, account_id, side, cast(t.quantity AS double) AS quantity, cast(price AS double) AS price,
  cast(settlement_date AS varchar) AS settlement_date,
  cast(cast(executed_at AS date) + 2 AS varchar) AS settlement_due
FROM trades t JOIN current_orders USING (order_id)""",
    "position_build": f"""WITH {POSITIONS}
SELECT account_id, instrument_id, cast(position_date AS varchar) AS position_date, cast(quantity AS double) AS quantity,
  cast(last_price AS double) AS last_price, cast(market_value AS double) AS market_value, execution_count, updated_at, last_trade_id
FROM valued""",
    "position_report": f"""WITH {POSITIONS}, {ACCOUNTS}, {INSTRUMENTS}
SELECT account_name, account_type, ticker, name AS instrument_name, cast(quantity AS double) AS quantity,
  cast(market_value AS double) AS market_value, cast(position_date AS varchar) AS position_date,
  cast(CASE WHEN quantity <> 0 THEN round(market_value / quantity, 2) END AS double) AS implied_price
FROM valued JOIN accounts USING (account_id) JOIN instruments USING (instrument_id)""",
    "net_position_top": f"""WITH {CURRENT_ORDERS}
SELECT account_id, instrument_id,
  cast(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS double) AS net_position,
  count(*) AS trade_count
FROM current_orders GROUP BY account_id, instrument_id
ORDER BY sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) DESC, account_id, instrument_id LIMIT 100""",
    "daily_notional_top": f"""WITH {CURRENT_ORDERS}, {TRADES}
SELECT cast(cast(executed_at AS date) AS varchar) AS trade_date, t.instrument_id, count(*) AS trade_count,
  cast(cast(sum(t.quantity * price) AS decimal(38,4)) AS double) AS notional_volume
FROM trades t JOIN current_orders o USING (order_id) WHERE status IN ('FILLED', 'PARTIAL')
GROUP BY 1, 2 ORDER BY 1 DESC, sum(t.quantity * price) DESC, 2 LIMIT 200""",
    "ticks_as_of_version": f"WITH {RAW_TICKS} SELECT {RAW_ROW} FROM raw_ticks WHERE batch <= 2",
    "ticks_as_of_timestamp": f"""WITH {RAW_TICKS}, {HISTORY}
SELECT {RAW_ROW} FROM raw_ticks WHERE batch <= (SELECT max(snapshot_id) FROM history
  WHERE committed_at <= (SELECT committed_at FROM history WHERE snapshot_id = 3))""",
    "ticks_between_versions": f"WITH {RAW_TICKS} SELECT {RAW_ROW} FROM raw_ticks WHERE batch > 1 AND batch <= 3",
    "snapshot_listing": f"WITH {RAW_TICKS}, {HISTORY} SELECT snapshot_id, committed_at, operation FROM history",
    "snapshot_history": f"""WITH {RAW_TICKS}, {HISTORY}
SELECT *, cast(sum(added_records) OVER (ORDER BY snapshot_id) AS bigint) AS total_records FROM history""",
    "snapshot_compare": f"""WITH {RAW_TICKS}
SELECT 'current' AS version, count(*) AS record_count FROM raw_ticks
UNION ALL SELECT 'previous', count(*) FROM raw_ticks WHERE batch <= 3""",
    "snapshot_row_changes": f"""WITH {RAW_TICKS}, {ticks_cte("before", "batch <= 3")}, {ticks_cte("after")}
SELECT coalesce(b.tick_id, a.tick_id) AS tick_id,
  CASE WHEN b.tick_id IS NULL THEN 'added' WHEN a.tick_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM before b FULL OUTER JOIN after a ON a.tick_id = b.tick_id
WHERE b.event_id IS DISTINCT FROM a.event_id""",
    "curated_as_of_version": f"""WITH {RAW_TICKS}, {ticks_cte("ticks", "batch <= 2")}
SELECT {TICK_COLUMNS} FROM ticks""",
    "schema_evolution_append": f"""WITH {RAW_TICKS}
SELECT event_id, event_type, CASE WHEN batch >= 3 THEN value END AS value, CASE WHEN batch >= 3 THEN 2 ELSE 1 END
  AS snapshot_id
FROM raw_ticks JOIN events USING (event_id)""",
    "quality_gate_metrics": f"""WITH {TICKS}
SELECT count(*) AS row_count, count(*) = count(ticker) AS no_null_ticker, count(*) = count(volume) AS no_null_volume,
  count(*) > 0 AS not_empty FROM ticks""",
    "file_profile": """SELECT 'events.parquet' AS file_name, count(*) AS row_count,
  count(DISTINCT user_id) AS unique_keys, min(ts) AS earliest_event, max(ts) AS latest_event,
  count(*) - count(user_id) AS null_keys FROM events""",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS record_count FROM {t}" for t in TABLES
    ),
    "table_freshness": f"""WITH {RAW_TICKS}, {ORDER_LOG},
newest AS (SELECT 'market_data' AS table_name, max(ts) AS last_commit FROM raw_ticks
           UNION ALL SELECT 'orders', max(updated_at) FROM order_log)
SELECT *, cast(floor((epoch_us((SELECT max(last_commit) FROM newest)) - epoch_us(last_commit)) / 1000000) AS bigint)
  AS lag_seconds FROM newest""",
    "contract_violations": f"""WITH {SUSPECT}
SELECT violation, count(*) AS row_count
FROM (SELECT unnest(string_split(violations, '; ')) AS violation FROM suspect WHERE violations <> '') GROUP BY 1""",
    "contract_quarantine": f"""WITH {SUSPECT}
SELECT cast(order_id AS varchar) AS order_id, op, violations FROM suspect WHERE violations <> ''""",
    "contract_valid": f"""WITH {SUSPECT}
SELECT cast(order_id AS varchar) AS order_id, op, status FROM suspect WHERE violations = ''""",
    "message_validation": """SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 'record: malformed' ELSE concat_ws('; ',
    CASE WHEN o_orderkey % 11 = 0 THEN 'side: not allowed' END,
    CASE WHEN o_orderkey % 13 = 0 THEN 'quantity: missing'
         WHEN o_orderkey % 17 = 0 THEN 'quantity: not a double' END) END AS violations
FROM orders""",
    "unique_violations": f"""WITH {RAW_TICKS}
SELECT tick_id, count(*) AS copies FROM raw_ticks GROUP BY tick_id HAVING count(*) > 1""",
    "fk_orphans": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)""",
    "topic_routing_counts": f"""WITH {TOPICS}
SELECT coalesce(tbl, 'unrouted') AS "table",
  CASE WHEN tbl IS NULL THEN 'none' WHEN tbl LIKE 'raw\\_mnpi%' ESCAPE '\\' THEN 'mnpi' ELSE 'nonmnpi' END AS zone,
  count(*) AS row_count
FROM routed GROUP BY 1, 2""",
    "cdc_unwrap": f"""WITH {MESSAGES}
SELECT 'cdc.trading.orders' AS _topic, cast(order_id AS varchar) AS order_id, side,
  cast(quantity AS varchar) AS quantity, cast(limit_price AS varchar) AS limit_price, status,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') AS updated_at, op, cast(order_id AS varchar) AS key,
  updated_at AS ts, log_offset
FROM messages""",
    "cdc_unwrap_drop": f"""WITH {MESSAGES}
SELECT 'cdc.trading.orders' AS _topic, cast(order_id AS varchar) AS order_id, status,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') AS updated_at
FROM messages WHERE op <> 'd'""",
    "message_quarantine": f"""WITH {ORDER_LOG}
SELECT 'cdc.trading.orders' AS _topic, log_offset, 'malformed' AS reason FROM order_log WHERE log_offset % 31 = 0""",
    "feed_quotes_to_ticks": f"""WITH {FEED},
quotes AS (
  SELECT *, cast(price AS decimal(18,6)) AS b, cast(price + 0.05 AS decimal(18,6)) AS a, size AS bid_size,
    CASE WHEN event_id % 3 <> 0 THEN size + 1 END AS ask_size FROM feed)
SELECT sha256(concat(symbol, '|', time_text, '|', b, '|', a, '|', bid_size, '|', ask_size)) AS tick_id, instrument_id,
  symbol AS ticker, cast(b AS double) AS bid, cast(a AS double) AS ask,
  cast(round(cast((cast(b AS decimal(28,6)) + a) * 0.5 AS decimal(28,7)), 2) AS double) AS last_price,
  bid_size + coalesce(ask_size, 0) AS volume, time AS timestamp
FROM quotes""",
    "feed_trades_to_orders": f"""WITH {FEED},
trades AS (
  SELECT *, event_id * 977 + 999000 AS trade_id, sha256(concat(symbol, '|', time_text, '|',
    event_id * 977 + 999000, '|', cast(price AS decimal(18,6)), '|', cast(size AS decimal(18,4)))) AS id
  FROM feed WHERE event_id % 4 <> 0)
SELECT id AS event_id, 'ORDER_CREATED' AS event_type, trade_id % 1000000 AS order_id, cast(3 AS bigint) AS account_id,
  instrument_id, symbol AS ticker, CASE WHEN id[1] < '8' THEN 'BUY' ELSE 'SELL' END AS side,
  cast(size AS double) AS quantity, cast(price AS double) AS limit_price, time AS timestamp
FROM trades""",
    "access_matrix": """WITH tagged AS (
  SELECT concat('part-', p_partkey) AS resource,
    CASE WHEN p_size % 2 = 0 THEN 'mnpi' ELSE 'non-mnpi' END AS sensitivity,
    CASE WHEN p_partkey % 7 <> 0 THEN ['raw', 'curated', 'analytics'][p_partkey % 3 + 1] END AS layer
  FROM part)
SELECT resource, principal,
  CASE WHEN layer IS NULL THEN 'DENIED'
       WHEN principal = 'data-engineer' THEN 'ALL'
       WHEN layer = 'raw' THEN 'DENIED'
       WHEN principal = 'data-analyst' AND sensitivity = 'mnpi' THEN 'DENIED'
       ELSE 'SELECT' END AS permission
FROM tagged, (VALUES ('finance-analyst'), ('data-analyst'), ('data-engineer')) AS p(principal)""",
    "audit_access_report": f"""WITH {AUDIT},
judged AS (
  SELECT *, CASE WHEN principal = 'data-engineer' THEN 'ALL'
       WHEN resource LIKE 'raw%' THEN 'DENIED'
       WHEN principal = 'data-analyst' AND resource NOT LIKE '%nonmnpi' THEN 'DENIED'
       ELSE 'SELECT' END AS permission FROM audit)
SELECT principal, resource, action, date_trunc('hour', accessed_at) AS access_hour, count(*) AS accesses,
  min(accessed_at) AS first_access, max(accessed_at) AS last_access, permission,
  permission = 'DENIED' AS outside_policy
FROM judged GROUP BY principal, resource, action, 4, permission""",
    "stream_ingest_routed": f"""WITH {TOPICS}
SELECT tbl AS table_name, event_id, _topic FROM routed WHERE tbl IS NOT NULL""",
    "stream_ohlc": f"""WITH {RAW_TICKS}
SELECT ticker, date_trunc('hour', ts) AS bar_start, count(*) AS tick_count, cast(sum(volume) AS bigint) AS total_volume,
  {rounded("arg_min(price, ts)", 2)} AS open_price, {rounded("max(price)", 2)} AS high_price,
  {rounded("min(price)", 2)} AS low_price, {rounded("arg_max(price, ts)", 2)} AS close_price
FROM raw_ticks WHERE ticker <> '' GROUP BY 1, 2""",
    "stream_dedup": "SELECT event_id, ts, event_type, value FROM events",
    "medallion_run": f"""WITH {TICKS}, {ORDER_EVENTS}
SELECT 'curated_mnpi.order_events' AS table_name, 'full' AS mode, cast(3 AS bigint) AS watermark,
  count(*) AS row_count FROM order_events
UNION ALL SELECT 'curated_nonmnpi.market_ticks', 'full', 4, count(*) FROM ticks
UNION ALL SELECT 'analytics_mnpi.order_summary', 'full', 1,
  count(*) FROM (SELECT DISTINCT instrument_id, order_hour FROM order_events)
UNION ALL SELECT 'analytics_nonmnpi.market_summary', 'full', 1,
  count(*) FROM (SELECT DISTINCT ticker, tick_hour FROM ticks)""",
}
ORACLES["incremental_entity_merge"] = ORACLES["merge_orders"]
ORACLES["position_fold"] = ORACLES["position_build"]
for _name, _hidden in {
    "orders": "created_at",
    "trades": "",
    "positions": "",
    "accounts": "created_at",
    "instruments": "created_at",
}.items():
    _columns = f"* EXCLUDE ({_hidden})" if _hidden else "*"
    ORACLES[f"late_{_name}"] = f"SELECT {_columns} FROM ({ORACLES[f'merge_{_name}']})"
ORACLES["ingest_unrouted"] = f"WITH {TOPICS} SELECT event_id, _topic FROM routed WHERE tbl IS NULL"
ORACLES["feed_quarantine"] = """SELECT reason, count(*) AS row_count FROM (
  SELECT CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_id % 5 = 1 THEN 'bid is missing or unreadable'
              WHEN event_id % 5 = 2 AND event_id % 4 <> 0 THEN 'price is missing or unreadable' END AS reason FROM events)
WHERE reason IS NOT NULL GROUP BY 1"""

POSITION_LOG = """
position_log AS (
  SELECT o_custkey * 50 + o_orderkey % 50 AS position_id, o_custkey AS account_id, o_orderkey % 50 AS instrument_id,
    cast(o_orderdate AS date) AS position_date
  FROM orders WHERE o_orderkey % 89 <> 0)"""
ORACLES["contract_unique"] = f"""WITH {TRADE_LOG}, {POSITION_LOG},
account_log AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0),
instrument_log AS (SELECT p_partkey AS id FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 20 = 0),
found AS (
  SELECT 'trades' AS table_name, trade_id AS row_key,
    CASE WHEN count(*) OVER (PARTITION BY trade_id) > 1 THEN 'trade_id: not unique' ELSE '' END AS violations FROM trade_log
  UNION ALL SELECT 'positions', position_id, concat_ws('; ',
    CASE WHEN count(*) OVER (PARTITION BY position_id) > 1 THEN 'position_id: not unique' END,
    CASE WHEN count(*) OVER (PARTITION BY account_id, instrument_id, position_date) > 1
         THEN 'account_id, instrument_id, position_date: not unique' END) FROM position_log
  UNION ALL SELECT 'accounts', id,
    CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'account_id: not unique' ELSE '' END FROM account_log
  UNION ALL SELECT 'instruments', id,
    CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'instrument_id: not unique; ticker: not unique' ELSE '' END
  FROM instrument_log)
SELECT * FROM found WHERE violations <> ''"""
ORACLES["contract_references"] = f"""WITH {TRADE_LOG}, {POSITION_LOG},
held AS (SELECT o_orderkey, o_custkey, o_orderkey % 50 AS instrument_id FROM orders WHERE o_orderkey % 97 <> 0),
found AS (
  SELECT 'orders' AS table_name, o_orderkey AS row_key, concat_ws('; ',
    CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'account_id: not in accounts' END,
    CASE WHEN instrument_id NOT IN (SELECT p_partkey FROM part) THEN 'instrument_id: not in instruments' END) AS violations
  FROM held
  UNION ALL SELECT 'trades', trade_id, concat_ws('; ',
    CASE WHEN order_id NOT IN (SELECT o_orderkey FROM held) THEN 'order_id: not in orders' END,
    CASE WHEN instrument_id NOT IN (SELECT p_partkey FROM part) THEN 'instrument_id: not in instruments' END)
  FROM trade_log
  UNION ALL SELECT 'positions', position_id, concat_ws('; ',
    CASE WHEN account_id NOT IN (SELECT c_custkey FROM customer) THEN 'account_id: not in accounts' END,
    CASE WHEN instrument_id NOT IN (SELECT p_partkey FROM part) THEN 'instrument_id: not in instruments' END)
  FROM position_log)
SELECT * FROM found WHERE violations <> ''"""
ORACLES["market_summary_deltas"] = ORACLES["market_summary_hourly"]
ORACLES["order_summary_deltas"] = ORACLES["order_summary_hourly"]
ORACLES["executions_bucketed"] = ORACLES["executions_enriched"]
AS_OF = """
moments AS (SELECT unnest([TIMESTAMP '1994-12-31 23:00:00', TIMESTAMP '1995-12-31 23:00:00', TIMESTAMP '1996-12-31 23:00:00',
  TIMESTAMP '1997-12-31 23:00:00', TIMESTAMP '1998-12-31 23:00:00']) AS as_of)"""
ORACLES["orders_as_of_moments"] = f"""WITH {ORDER_LOG}, {AS_OF},
state AS (SELECT as_of, order_id, op, status FROM order_log JOIN moments ON updated_at <= as_of
  QUALIFY row_number() OVER (PARTITION BY as_of, order_id ORDER BY updated_at DESC, seq DESC) = 1)
SELECT as_of, status, count(*) AS orders FROM state WHERE op <> 'd' GROUP BY 1, 2"""
ORACLES["orders_as_of_many"] = f"""WITH {ORDER_LOG}, {TRADES},
found AS (SELECT trade_id, order_id, executed_at, status, op, updated_at AS valid_from
  FROM trades t JOIN order_log l USING (order_id) WHERE l.updated_at <= t.executed_at
  QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY l.updated_at DESC, l.seq DESC) = 1)
SELECT * EXCLUDE (op) FROM found WHERE op <> 'd'"""
ORACLES["stream_positions"] = ORACLES["position_build"]
ORACLES["ingest_in_one_write"] = f"""WITH {TOPICS},
named AS (SELECT CASE WHEN event_id % 23 = 0 THEN 'rejected' ELSE coalesce(tbl, 'unrouted') END AS "table" FROM routed)
SELECT "table", CASE WHEN "table" LIKE 'raw\\_mnpi%' ESCAPE '\\' THEN 'mnpi' WHEN "table" LIKE 'raw%' THEN 'nonmnpi' ELSE 'none' END AS zone,
  count(*) AS row_count, count(*) AS counted
FROM named GROUP BY 1, 2"""
ORACLES["full_refresh_after_increments"] = f"SELECT *, 'full' AS mode, cast(4 AS bigint) AS watermark FROM ({CURATED_TICKS})"
ORACLES["empty_increment"] = f"""WITH {TICKS}, n AS (SELECT count(*) AS c FROM ticks)
SELECT run, mode, watermark, CASE WHEN run = 0 THEN c ELSE 0 END AS row_count, stored_watermark, c AS stored_rows
FROM n, (VALUES (cast(0 AS bigint), 'full', cast(4 AS bigint), cast(5 AS bigint)), (1, 'incremental', 5, 5), (2, 'skip', 5, 5))
  AS r(run, mode, watermark, stored_watermark)"""
ORACLES["market_data_contract"] = """SELECT * FROM (SELECT event_id, concat_ws('; ',
    CASE WHEN event_id % 13 = 0 THEN 'symbol: missing' END,
    CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'volume: not a bigint' END) AS violations FROM events)
WHERE violations <> ''"""
ORACLES["audit_file_report"] = ORACLES["audit_access_report"]
ORACLES["report_as_table"] = f"""SELECT *, false AS existed, true AS exists, cast(3 AS bigint) AS watermark
FROM ({ORACLES["order_summary_hourly"]})"""
ORACLES["orders_by_change_day"] = f"""WITH {ORDER_LOG}
SELECT cast(cast(updated_at AS date) AS varchar) AS day, op, count(*) AS changes FROM order_log GROUP BY 1, 2"""
