"""Audit log records, from JSON files or from a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.once import evaluate_once
from tidemark.model import AUDIT_RECORD

# What the access reports read.
REPORT_FIELDS = ("useridentity", "eventtime", "eventname", "resources")


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line, with the fixed schema: nothing is inferred, unread fields are skipped."""
    return spark.read.schema(AUDIT_RECORD).json(path)


def parse_audit(df: DataFrame, value_col: str = "value", fields: Sequence[str] = REPORT_FIELDS) -> DataFrame:
    """The named fields of records in a text column. Only these are decoded."""
    record = T.StructType.fromDDL(AUDIT_RECORD)
    wanted = T.StructType([f for f in record.fields if f.name in fields])
    return df.select(evaluate_once(F.from_json(value_col, wanted)).alias("record")).select("record.*")
