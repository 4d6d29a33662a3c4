"""Typed reads of string columns. Bad text becomes NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_whole(value: Column | str) -> Column:
    """Text or number to bigint, fraction cut off ('1000.7500' -> 1000).

    A direct cast of such text is an error under ANSI rules, so it goes through a decimal.
    """
    return _col(value).try_cast("decimal(38,4)").try_cast("bigint")


def parse_timestamp(value: Column | str) -> Column:
    """ISO-8601 / RFC-3339 text ('T' or blank, 'Z' or offset, up to microseconds) to timestamp."""
    return _col(value).try_cast("timestamp")


def parse_date(value: Column | str) -> Column:
    """Date from ISO text or from the epoch-day number that change logs carry for DATE columns."""
    text = _col(value).cast("string")
    epoch_days = F.when(text.rlike("^-?[0-9]{1,6}$"), text.try_cast("int"))
    return F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), epoch_days), text.try_cast("date"))


def epoch_ms_to_timestamp(value: Column | str) -> Column:
    return F.timestamp_millis(_col(value).cast("bigint"))


def epoch_ms_to_date(value: Column | str) -> Column:
    return F.to_date(epoch_ms_to_timestamp(value))


def to_typed(value: Column | str, data_type: str) -> Column:
    """Tolerant cast by type name, choosing the parser the type needs."""
    kind = data_type.lower()
    if kind == "timestamp":
        return parse_timestamp(value)
    if kind == "date":
        return parse_date(value)
    return _col(value).try_cast(data_type)


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on the last bits of a double.

    A double average changes in its last bits with the order of addition. Going through ten decimal
    places first makes x.xx4999999999999 and x.xx5 round alike.
    """
    return F.round(value.try_cast("decimal(38,10)"), digits).cast("double")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero or NULL denominator."""
    return F.try_divide(numerator, denominator)
