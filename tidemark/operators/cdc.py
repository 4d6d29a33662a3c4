"""Change-event envelopes to flat rows, and the reverse reading of both raw shapes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META_FIELDS = ("op", "offset", "source", "key", "ts", "target")


def unwrap_cdc(
    events: DataFrame,
    columns: Sequence[str],
    key: str,
    *,
    deletes: Literal["tag", "drop"] = "tag",
    target: str | None = None,
) -> DataFrame:
    """Envelope (`op`, `before`, `after`, `source_timestamp`) to the row's columns.

    tag: every event becomes a row with a `_cdc` struct; a delete shows the old image.
    drop: deletes and tombstones are left out and no `_cdc` is added.

    Initial-load events (`op = 'r'`) are ordinary rows. Fields are picked one by one, so a Parquet
    scan of the envelope reads only the requested leaves. Other input columns pass through.
    """
    envelope = ("op", "before", "after", "source_timestamp", "offset", "source")
    others = [c for c in events.columns if c not in envelope]
    live = events.where(F.col("op").isNotNull())
    if deletes == "drop":
        kept = live.where((F.col("op") != "d") & F.col("after").isNotNull())
        return kept.select(*others, *[F.col(f"after.{c}").alias(c) for c in columns])
    deleted = F.col("op") == "d"
    image = [F.when(deleted, F.col(f"before.{c}")).otherwise(F.col(f"after.{c}")).alias(c) for c in columns]
    key_value = F.when(deleted, F.col(f"before.{key}")).otherwise(F.col(f"after.{key}"))

    def optional(name: str, kind: str):
        return F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)

    meta = F.struct(
        F.col("op").alias("op"),
        optional("offset", "bigint").alias("offset"),
        optional("source", "string").alias("source"),
        key_value.cast("string").alias("key"),
        F.timestamp_millis("source_timestamp").alias("ts"),
        F.lit(target).cast("string").alias("target"),
    )
    return live.select(*others, *image, meta.alias("_cdc"))
