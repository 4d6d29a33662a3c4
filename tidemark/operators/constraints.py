"""Uniqueness and references of contracts, checked over whole tables.

Broken keys are found first: the keys of all constraints of a table go through one partial aggregate, so each map task sends one row a
key, however hot it is. The few broken ones are staged, and the rows are tagged by joins with them: broadcast while they are small, else
as joins whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import to_typed
from tidemark.model import Contract
from tidemark.operators.contracts import VIOLATIONS, split_valid
from tidemark.session import staged


def _key(contract: Contract, columns: Sequence[str], of: DataFrame) -> Column:
    """The typed values as texts, so that '007' and 7 are one number; NULL if one is missing or unreadable."""
    kinds = {rule.name: rule.kind for rule in contract.fields}
    parts = [to_typed(of[c], kinds.get(c, "string")).cast("string") for c in columns]
    return F.when(reduce(and_, (p.isNotNull() for p in parts)), F.array(*parts))


def _digest(key: Column) -> Column:
    """A long to sort and join keys by, before they are compared themselves: Spark sorts rows by arrays several times slower."""
    return F.when(key.isNotNull(), F.xxhash64(key))


def _unique(contract: Contract) -> dict[str, tuple[str, ...]]:
    return {f"{', '.join(columns)}: not unique": columns for columns in contract.unique}


def _references(contract: Contract) -> dict[str, tuple[str, str, str]]:
    return {f"{column}: not in {table}": (column, table, parent) for column, table, parent in contract.references}


def _counted(df: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """(violation, key, copies) of all keys, by one pass over the rows."""
    entries = F.array(*[F.struct(F.lit(name).alias("violation"), key.alias("key")) for name, key in keys.items()])
    rows = df.select(F.explode(entries).alias("e")).select("e.violation", "e.key").where(F.col("key").isNotNull())
    return rows.groupBy("violation", "key").agg(F.count(F.lit(1)).alias("copies"))


def duplicate_keys(df: DataFrame, contract: Contract) -> DataFrame | None:
    """(violation, key, copies) of keys that occur more than once. Keys with a NULL part are exempt."""
    keys = {name: _key(contract, columns, df) for name, columns in _unique(contract).items()}
    return _counted(df, keys).where(F.col("copies") > 1) if keys else None


def orphan_keys(tables: Mapping[str, DataFrame], name: str, contracts: Mapping[str, Contract]) -> DataFrame | None:
    """(violation, key, copies) of references without a parent row. A NULL reference is no orphan.

    References are reduced to their distinct keys before they meet the parents, which are merged with them and never broadcast.
    """
    contract, df = contracts[name], tables[name]
    references = _references(contract)
    if not references:
        return None
    children = _counted(df, {v: _key(contract, [column], df) for v, (column, _, _) in references.items()})
    parents = None
    for violation, (_, table, column) in references.items():
        parent = tables[table]
        rows = parent.select(F.lit(violation).alias("violation"), _key(contracts[table], [column], parent).alias("key"))
        parents = rows if parents is None else parents.unionByName(rows)
    return children.join(parents.hint("merge"), ["violation", "key"], "left_anti")


def tag_broken(df: DataFrame, contract: Contract, broken: DataFrame) -> DataFrame:
    """Add `violations`: the constraints that a row's keys break, by (violation, key) of `broken`, unique by both.

    Which constraints are broken at all is looked up first: the others need no join, and without any the quarantine is empty by plan.
    """
    found = {row["violation"] for row in broken.select("violation").distinct().collect()}
    constraints = {**_unique(contract), **{v: (column,) for v, (column, _, _) in _references(contract).items()}}
    constraints = {violation: columns for violation, columns in constraints.items() if violation in found}
    tagged, flags = df, []
    for number, (violation, columns) in enumerate(constraints.items()):
        name, digest = f"__broken_{number}", f"__digest_{number}"
        keys = broken.where(F.col("violation") == violation)
        keys = keys.select(F.col("key").alias(name), _digest(F.col("key")).alias(digest))
        key = _key(contract, columns, df)
        tagged = tagged.join(keys, (_digest(key) == F.col(digest)) & (key == F.col(name)), "left")
        flags.append(F.when(F.col(name).isNotNull(), F.lit(violation)))
    codes = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return tagged.select(*[df[c] for c in df.columns], codes.alias(VIOLATIONS))


def check_constraints(
    tables: Mapping[str, DataFrame],
    contracts: Mapping[str, Contract],
    *,
    unique: bool = True,
    references: bool = True,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(valid rows, quarantined rows with `violations`) of each table.

    All rows of a repeated key are quarantined: which of them is right, the contract does not say. Parents count with all
    their rows, quarantined or not. Broken keys are staged in the shared folder.
    """
    result = {}
    for name, df in tables.items():
        found = [duplicate_keys(df, contracts[name])] if unique else []
        found += [orphan_keys(tables, name, contracts)] if references else []
        found = [f for f in found if f is not None]
        if found:
            broken = staged(reduce(DataFrame.unionByName, found), f"broken-{name}")
            result[name] = split_valid(tag_broken(df, contracts[name], broken))
        else:
            result[name] = df, df.limit(0).withColumn(VIOLATIONS, F.array().cast("array<string>"))
    return result
