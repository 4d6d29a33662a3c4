"""Order-flow and market summaries at any grain, and exact roll-ups of them.

Each summary is split in two: additive measures (one aggregate, pre-aggregated in the map tasks), and
a finishing projection that derives averages and ratios. Rolling hourly measures up to days therefore
gives the same averages as summarising the days directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import place_in_hour, safe_ratio, stable_round


def _count_rows() -> Column:
    return F.count(F.lit(1))


# ------------------------------------------------------------------------------------ orders


def order_measures(df: DataFrame, grain: Sequence[str], event_time: str = "created_at") -> DataFrame:
    """Additive order measures per grain. An unknown side counts in the total only."""
    return df.groupBy(*grain).agg(
        _count_rows().alias("total_orders"),
        F.count_if(F.col("is_buy")).alias("buy_orders"),
        F.count_if(~F.col("is_buy")).alias("sell_orders"),
        F.sum("quantity").alias("total_volume"),
        F.count("quantity").alias("sized_orders"),
        F.min(event_time).alias("first_order_at"),
        F.max(event_time).alias("last_order_at"),
    )


def roll_up_orders(measures: DataFrame, grain: Sequence[str]) -> DataFrame:
    added = ["total_orders", "buy_orders", "sell_orders", "total_volume", "sized_orders"]
    return measures.groupBy(*grain).agg(
        *[F.sum(c).alias(c) for c in added],
        F.min("first_order_at").alias("first_order_at"),
        F.max("last_order_at").alias("last_order_at"),
    )


def finish_orders(measures: DataFrame, grain: Sequence[str], *, whole_average: bool = True) -> DataFrame:
    average = stable_round(
        safe_ratio(F.col("total_volume").cast("double"), F.col("sized_orders").cast("double")), 0
    )
    ratio = safe_ratio(F.col("buy_orders").cast("double"), F.col("sell_orders").cast("double"))
    return measures.select(
        *grain,
        "total_orders",
        "buy_orders",
        "sell_orders",
        "total_volume",
        (average.cast("bigint") if whole_average else average).alias("avg_order_size"),
        stable_round(ratio, 2).alias("buy_sell_ratio"),
        "first_order_at",
        "last_order_at",
    )


def order_summary(
    df: DataFrame,
    grain: Sequence[str] = ("instrument_id", "order_hour"),
    *,
    event_time: str = "created_at",
    whole_average: bool = True,
) -> DataFrame:
    """Counts, buy/sell split, volume, average size and buy/sell ratio (NULL without sells)."""
    return finish_orders(order_measures(df, grain, event_time), grain, whole_average=whole_average)


# ------------------------------------------------------------------------------------ market


def market_measures(df: DataFrame, grain: Sequence[str], *, tie_breaker: str = "tick_id") -> DataFrame:
    """Additive market measures per grain; with `tick_hour` in the grain also open and close.

    Opening and closing price come out of the same hash aggregate as everything else: no ranking
    windows, no self join, no sort. A NULL price at the first or last tick stays NULL. Ticks without a
    readable time belong to no hour and are left out where hours matter.
    """
    measures = [
        _count_rows().alias("tick_count"),
        F.sum("volume").alias("total_volume"),
        F.min("last_price").alias("low"),
        F.max("last_price").alias("high"),
        *[
            column
            for name in ("last_price", "spread", "mid_price")
            for column in (F.sum(name).alias(f"{name}_sum"), F.count(name).alias(f"{name}_n"))
        ],
        F.min("tick_timestamp").alias("first_tick_at"),
        F.max("tick_timestamp").alias("last_tick_at"),
    ]
    if "tick_hour" in grain:
        place = place_in_hour(F.col("tick_timestamp"), F.col("tick_hour"), F.col(tie_breaker))
        measures += [F.min_by("last_price", place).alias("open"), F.max_by("last_price", place).alias("close")]
        df = df.where(F.col("tick_hour").isNotNull())
    return df.groupBy(*grain).agg(*measures)


def roll_up_market(measures: DataFrame, grain: Sequence[str], order_by: str = "tick_hour") -> DataFrame:
    """Coarser grain from finer market measures; `order_by` is the time part that goes away."""
    added = ["tick_count", "total_volume"] + [
        f"{name}_{part}" for name in ("last_price", "spread", "mid_price") for part in ("sum", "n")
    ]
    prices = []
    if "open" in measures.columns:
        prices = [F.min_by("open", order_by).alias("open"), F.max_by("close", order_by).alias("close")]
    return measures.groupBy(*grain).agg(
        *[F.sum(c).alias(c) for c in added],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("first_tick_at").alias("first_tick_at"),
        F.max("last_tick_at").alias("last_tick_at"),
        *prices,
    )


def finish_market(measures: DataFrame, grain: Sequence[str]) -> DataFrame:
    def average(name: str) -> Column:
        return safe_ratio(F.col(f"{name}_sum"), F.col(f"{name}_n").cast("double"))

    prices = []
    if "open" in measures.columns:
        prices = [stable_round(F.col("open"), 2).alias("open_price"), stable_round(F.col("close"), 2).alias("close_price")]
    return measures.select(
        *grain,
        "tick_count",
        "total_volume",
        stable_round(F.col("low"), 2).alias("low_price"),
        stable_round(F.col("high"), 2).alias("high_price"),
        stable_round(average("last_price"), 2).alias("avg_price"),
        stable_round(average("spread"), 4).alias("avg_spread"),
        stable_round(average("mid_price"), 2).alias("avg_mid_price"),
        stable_round(safe_ratio(average("spread"), average("mid_price")) * 100, 4).alias("spread_pct"),
        "first_tick_at",
        "last_tick_at",
        *prices,
    )


def market_summary(
    df: DataFrame,
    grain: Sequence[str] = ("ticker", "tick_hour"),
    *,
    ohlc: bool = True,
    tie_breaker: str = "tick_id",
) -> DataFrame:
    """Tick count, volume, price range, averages, spread in percent of mid, and OHLC prices.

    At a grain without the hour, open and close are found per hour first and then rolled up.
    """
    if ohlc and "tick_hour" not in grain:
        hourly = market_measures(df, [*grain, "tick_hour"], tie_breaker=tie_breaker)
        return finish_market(roll_up_market(hourly, grain), grain)
    measures = market_measures(df, grain, tie_breaker=tie_breaker)
    return finish_market(measures if ohlc else measures.drop("open", "close"), grain)
