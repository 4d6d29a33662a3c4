"""Topic based routing of raw messages to tables and sensitivity zones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import TOPIC_ROUTES, Route


class ZoneConflictError(ValueError):
    """One table would receive rows of two sensitivity zones."""


def short_topic(topic: Column) -> Column:
    """`<prefix>.public.<table>` without the schema part; other names stay."""
    return F.regexp_replace(topic, r"^(.+)\.public\.(.*)$", "$1.$2")


def check_zones(routes: Iterable[Route]) -> None:
    """The zone follows from the table, never from row content."""
    zones: dict[str, str] = {}
    for route in routes:
        if zones.setdefault(route.table, route.zone) != route.zone:
            raise ZoneConflictError(f"{route.table} is routed to both {zones[route.table]} and {route.zone}")


def _matches(topic: Column, routes: Iterable[Route]) -> list[Column]:
    """Per route the (table, zone) pair when its pattern matches the whole topic name, else NULL.

    The rules are a short configuration list, so they become expressions instead of a join.
    """
    routes = tuple(routes)
    check_zones(routes)
    return [
        F.when(
            topic.rlike(f"^(?:{r.pattern})$"),
            F.struct(F.lit(r.table).alias("table"), F.lit(r.zone).alias("zone")),
        )
        for r in routes
    ]


def route(df: DataFrame, routes: Iterable[Route] = TOPIC_ROUTES, topic_col: str = "_topic") -> DataFrame:
    """Add `table` and `zone`. A row goes to every table that matches; unmatched rows drop out."""
    candidates = F.array(*_matches(F.col(topic_col), routes))
    exploded = df.withColumn("__route", F.explode(candidates)).where(F.col("__route").isNotNull())
    return exploded.select(*df.columns, "__route.table", "__route.zone")


def every_route(df: DataFrame, routes: Iterable[Route] = TOPIC_ROUTES, topic_col: str = "_topic") -> DataFrame:
    """Add `table` and `zone` to every row: those of its rules, or ('unrouted', 'none'), or ('rejected', 'none') without a topic."""
    matched = F.array_compact(F.array(*_matches(F.col(topic_col), routes)))
    name = F.when(F.col(topic_col).isNull(), "rejected").otherwise("unrouted")
    rest = F.array(F.struct(name.alias("table"), F.lit("none").alias("zone")))
    chosen = df.withColumn("__route", F.explode(F.when(F.size(matched) > 0, matched).otherwise(rest)))
    return chosen.select(*df.columns, "__route.table", "__route.zone")


def unrouted(df: DataFrame, routes: Iterable[Route] = TOPIC_ROUTES, topic_col: str = "_topic") -> DataFrame:
    """Rows no rule matches, for monitoring."""
    return df.where(F.coalesce(*_matches(F.col(topic_col), routes)).isNull())
