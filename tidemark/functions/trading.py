"""Column expressions of the trading domain; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def mid_price(bid: Column, ask: Column) -> Column:
    return (ask + bid) / F.lit(2.0)


def is_buy(side: Column) -> Column:
    """NULL for an unknown side, so that it counts as neither buy nor sell."""
    return side == F.lit("BUY")


def signed_quantity(side: Column, quantity: Column) -> Column:
    return F.when(side == F.lit("BUY"), quantity).otherwise(-quantity)


def implied_price(market_value: Column, quantity: Column) -> Column:
    return F.round(F.try_divide(market_value, quantity), 2)


def quote_midpoint(bid: Column, ask: Column) -> Column:
    """Mid of two decimals, half-up to cents."""
    return F.round((bid + ask) / F.lit(2), 2)


def quote_volume(bid_size: Column, ask_size: Column) -> Column:
    return F.coalesce(bid_size, F.lit(0)) + F.coalesce(ask_size, F.lit(0))


def settlement_date(trade_date: Column, days: int = 2) -> Column:
    """Settlement in calendar days after the trade."""
    return F.date_add(trade_date, days)


def place_in_hour(at: Column, hour: Column, tie_breaker: Column) -> Column:
    """Order of events within one hour as a single long: microseconds, then a hash of `tie_breaker`.

    A fixed-width order lets `min_by` / `max_by` run as a hash aggregate; with a struct Spark has to sort
    the whole input first. Events of the same microsecond are settled by 31 bits of hash, so the
    result does not depend on how the rows are spread over tasks.
    """
    micros = F.unix_micros(at) - F.unix_micros(hour)
    return F.shiftleft(micros, 31).bitwiseOR(F.xxhash64(tie_breaker).bitwiseAND(F.lit(0x7FFFFFFF)))
