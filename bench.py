"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS: local cores (default: all)
Arguments: names of queries to time instead of the headline ones ("all" for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.session import build_session
from tidemark.testdata.queries import QUERIES

HEADLINE = [
    "market_ticks_curated",
    "market_summary_hourly",
    "market_summary_ticker",
    "order_events_curated",
    "order_summary_hourly",
    "order_current_state_remove",
    "merge_orders",
    "merge_trades",
    "trade_summary_daily",
    "position_build",
    "position_report",
    "net_position_top",
    "daily_notional_top",
    "cdc_unwrap",
    "contract_quarantine",
    "message_validation",
    "feed_quotes_to_ticks",
    "audit_access_report",
    "file_profile",
    "incremental_equals_full",
    "snapshot_history",
    "stream_ohlc",
    "stream_curated_ticks",
    "medallion_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": cpus,
    }
    spark = build_session("bench", f"local[{cpus}]", conf)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    QUERIES["market_ticks_curated"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
