"""Keeping an expensive expression from being copied by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluate_once(expression: Column) -> Column:
    """The expression as the output of a generator with one row.

    As a plain column, an expression such as a JSON parse is copied into every later filter and field
    access that Spark merges with it. A generator's output is computed once and then only referred to.
    Use it as a single column of a `select`.
    """
    return F.explode(F.array(expression))
