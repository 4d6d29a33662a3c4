"""JSON messages to typed columns, with a quarantine for what cannot be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.once import evaluate_once

_BAD = "__unparsed"
_PARSED = "__parsed"


@dataclass(frozen=True)
class ParsedMessages:
    """`valid`: message fields next to the remaining input columns.
    `quarantine`: input columns plus `reason`.
    """

    valid: DataFrame
    quarantine: DataFrame


def parse_messages(df: DataFrame, schema: T.StructType, value_col: str = "value") -> ParsedMessages:
    """Parse a JSON text column, bare (`{...}`) or wrapped (`{"schema": ..., "payload": {...}}`).

    One parse reads both forms. A NULL value is a tombstone: it is neither valid nor quarantined.
    """
    if "payload" in schema.names:
        raise ValueError("a message field named payload cannot be told from the wrapper")
    wrapper = T.StructType(
        [*schema.fields, T.StructField("payload", schema), T.StructField(_BAD, T.StringType())]
    )
    others = [c for c in df.columns if c != value_col]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    once = evaluate_once(F.from_json(value_col, wrapper, options))
    parsed = df.where(F.col(value_col).isNotNull()).select(*df.columns, once.alias(_PARSED))
    wrapped = F.col(f"{_PARSED}.payload").isNotNull()
    fields = [
        F.when(wrapped, F.col(f"{_PARSED}.payload.{name}")).otherwise(F.col(f"{_PARSED}.{name}")).alias(name)
        for name in schema.names
    ]
    anything = F.lit(False)
    for name in [*schema.names, "payload"]:
        anything = anything | F.col(f"{_PARSED}.{name}").isNotNull()
    malformed = F.col(_PARSED).isNull() | F.col(f"{_PARSED}.{_BAD}").isNotNull()
    reason = F.when(malformed, F.lit("malformed")).when(~anything, F.lit("no known field"))
    valid = parsed.where(reason.isNull()).select(*others, *fields)
    quarantine = parsed.where(reason.isNotNull()).select(*others, value_col, reason.alias("reason"))
    return ParsedMessages(valid, quarantine)
