"""Run a query on Spark and its oracle on DuckDB and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, db, sql: str, show: int = 4) -> str | None:
    """None when schema and rows agree, else a description."""
    result = db.execute(sql)
    names, expected = _sorted([d[0] for d in result.description], result.fetchall())
    columns, actual = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if columns != names:
        return f"columns {columns} != {names}"
    if actual == expected:
        return None
    missing, extra = set(expected) - set(actual), set(actual) - set(expected)
    return (
        f"rows {len(actual)} vs oracle {len(expected)}; {names}\n"
        f"  only spark : {sorted(extra)[:show]}\n  only oracle: {sorted(missing)[:show]}"
    )
