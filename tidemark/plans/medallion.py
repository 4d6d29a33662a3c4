"""The whole raw to curated to analytics run with its dependency gate."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.quality import ObservedGate, no_nulls, not_empty
from tidemark.operators.summaries import market_summary, order_summary
from tidemark.plans.curated import curate_market_ticks, curate_order_events, tie_names
from tidemark.plans.incremental import RunResult, run_incremental
from tidemark.sources.versioned import SNAPSHOT, VersionedTable


@dataclass(frozen=True)
class MedallionTables:
    raw_orders: VersionedTable
    raw_ticks: VersionedTable
    order_events: VersionedTable
    market_ticks: VersionedTable
    order_summary: VersionedTable
    market_summary: VersionedTable

    @classmethod
    def under(cls, spark: SparkSession, root: str, buckets: int = 16) -> MedallionTables:
        return cls(
            raw_orders=VersionedTable(spark, f"{root}/raw_mnpi/orders"),
            raw_ticks=VersionedTable(spark, f"{root}/raw_nonmnpi/market_data"),
            order_events=VersionedTable(
                spark,
                f"{root}/curated_mnpi/order_events",
                bucket_keys=["order_id"],
                buckets=buckets,
                sort_by=["created_at"],
            ),
            market_ticks=VersionedTable(
                spark,
                f"{root}/curated_nonmnpi/market_ticks",
                bucket_keys=["tick_id"],
                buckets=buckets,
                sort_by=["tick_timestamp"],
            ),
            order_summary=VersionedTable(spark, f"{root}/analytics_mnpi/order_summary"),
            market_summary=VersionedTable(spark, f"{root}/analytics_nonmnpi/market_summary"),
        )


def _analytics(
    name: str,
    target: VersionedTable,
    source: VersionedTable,
    summarise: Callable[[DataFrame], DataFrame],
    full_refresh: bool,
) -> RunResult:
    """Recompute a summary, unless its curated table is still the one it was computed from."""
    version = source.current()
    if not full_refresh and target.watermark() == version:
        return RunResult(name, "skip", target.current(), version, 0)
    gate = ObservedGate(name, not_empty())
    snapshot = target.replace(summarise(source.read_as_of(version)), watermark=version, gate=gate)
    return RunResult(name, "full", snapshot, version, gate.metrics["row_count"])


def run_medallion(
    tables: MedallionTables,
    *,
    order_tie_breakers: tuple[str, ...] = (),
    tick_tie_breakers: tuple[str, ...] = (),
    full_refresh: bool = False,
) -> list[RunResult]:
    """Both curated jobs side by side, then both summaries, but only if both curated jobs succeeded.

    A failing job raises; the summaries are then not started. Of rows of equal time and tie breakers the one of the later
    raw snapshot wins. Curated rows keep what decided, so that increments and a full refresh agree.
    """
    t = tables
    order_ties, tick_ties = (*order_tie_breakers, SNAPSHOT), (*tick_tie_breakers, SNAPSHOT)
    with ThreadPoolExecutor(max_workers=2) as pool:
        curated = [
            pool.submit(
                run_incremental,
                "curated_mnpi.order_events",
                t.raw_orders,
                t.order_events,
                lambda raw: curate_order_events(raw, order_ties, keep_ties=True),
                ["updated_at"],
                no_nulls("order_id"),
                tie_breakers=tie_names(order_ties),
                with_snapshot=True,
                full_refresh=full_refresh,
            ),
            pool.submit(
                run_incremental,
                "curated_nonmnpi.market_ticks",
                t.raw_ticks,
                t.market_ticks,
                lambda raw: curate_market_ticks(raw, tick_ties, keep_ties=True),
                ["tick_timestamp"],
                no_nulls("ticker"),
                tie_breakers=tie_names(tick_ties),
                with_snapshot=True,
                full_refresh=full_refresh,
            ),
        ]
        results = [job.result() for job in curated]
        summaries = [
            pool.submit(
                _analytics,
                "analytics_mnpi.order_summary",
                t.order_summary,
                t.order_events,
                order_summary,
                full_refresh,
            ),
            pool.submit(
                _analytics,
                "analytics_nonmnpi.market_summary",
                t.market_summary,
                t.market_ticks,
                market_summary,
                full_refresh,
            ),
        ]
        return results + [job.result() for job in summaries]
