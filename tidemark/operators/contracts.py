"""Contracts: value rules, message rules, uniqueness and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import to_typed
from tidemark.functions.once import evaluate_once
from tidemark.model import Contract, FieldRule

VIOLATIONS = "violations"


def _rule_codes(rule: FieldRule, present: Column, readable: Column, value: Column | None) -> list[Column]:
    codes = [F.when(present & ~readable, F.lit(f"{rule.name}: not a {rule.kind}"))]
    if rule.required:
        codes.insert(0, F.when(~present, F.lit(f"{rule.name}: missing")))
    if rule.allowed:
        codes.append(F.when(present & readable & ~value.isin(*rule.allowed), F.lit(f"{rule.name}: not allowed")))
    return codes


def _with_violations(df: DataFrame, codes: list[Column]) -> DataFrame:
    # Taking away the NULLs as a set stays in generated code; a lambda over the array would not, and
    # would pull every rule into interpreted evaluation. Codes are distinct, so nothing else is lost.
    no_code = F.array(F.lit(None).cast("string"))
    return df.withColumn(VIOLATIONS, F.array_except(F.array(*codes), no_code))


def tag_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Add `violations`: one text per broken rule, empty for a valid row. Narrow, one pass."""
    codes = []
    for rule in contract.fields:
        value = F.col(rule.name) if rule.name in df.columns else F.lit(None).cast("string")
        readable = F.lit(True) if rule.kind == "string" else to_typed(value, rule.kind).isNotNull()
        codes += _rule_codes(rule, value.isNotNull(), readable, value)
    return _with_violations(df, codes)


# Which JSON types a field kind takes, as the variant type names Spark reports.
_JSON_TYPES = {
    "string": "^STRING$",
    "double": "^(BIGINT|DECIMAL.*|DOUBLE)$",
    "bigint": "^BIGINT$",
}


def tag_message_violations(df: DataFrame, contract: Contract, value_col: str = "value") -> DataFrame:
    """Check JSON records against a message contract, with JSON types taken strictly:
    the text "100" is not a number. Fields the contract does not name are ignored.
    """
    bad = "__unparsed"
    fields = ", ".join(f"`{rule.name}` variant" for rule in contract.fields)
    parse = F.from_json(value_col, f"{fields}, {bad} string", {"columnNameOfCorruptRecord": bad})
    parsed = df.select(*df.columns, evaluate_once(parse).alias("__record"))
    is_object = F.trim(F.col(value_col)).startswith("{") & F.col(f"__record.{bad}").isNull()
    looked_up = parsed.select(
        *df.columns,
        F.coalesce(is_object, F.lit(False)).alias("__object"),
        *[F.schema_of_variant(f"__record.{rule.name}").alias(f"__kind_{rule.name}") for rule in contract.fields],
        *[
            F.try_variant_get(F.col(f"__record.{rule.name}"), "$", "string").alias(f"__value_{rule.name}")
            for rule in contract.fields
            if rule.allowed
        ],
    )
    codes = [F.when(~F.col("__object"), F.lit("record: malformed"))]
    for rule in contract.fields:
        kind = F.col(f"__kind_{rule.name}")
        # A JSON null reads as a variant of type VOID.
        present = F.coalesce(kind != "VOID", F.lit(False))
        readable = F.coalesce(kind.rlike(_JSON_TYPES[rule.kind]), F.lit(False))
        value = F.col(f"__value_{rule.name}") if rule.allowed else None
        codes += [F.when(F.col("__object"), code) for code in _rule_codes(rule, present, readable, value)]
    return _with_violations(looked_up, codes).select(*df.columns, VIOLATIONS)


def split_valid(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the tag, quarantined rows with it)."""
    broken = F.size(VIOLATIONS) > 0
    return tagged.where(~broken).drop(VIOLATIONS), tagged.where(broken)


def check_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    return split_valid(tag_violations(df, contract))


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count. Rows with a NULL key part are exempt."""
    complete = df
    for key in keys:
        complete = complete.where(F.col(key).isNotNull())
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def find_orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference has no parent row; a NULL reference is no orphan.

    Parents are merged, not broadcast: they are as many as the parent table's rows, and Spark takes the keys of a derived table for much
    smaller than they are.
    """
    parents = parent.select(F.col(parent_column).alias("__parent")).hint("merge")
    referencing = df.where(F.col(column).isNotNull())
    return referencing.join(parents, F.col(column) == F.col("__parent"), "left_anti")
