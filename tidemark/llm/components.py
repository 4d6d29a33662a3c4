"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that it can reach.

    edges has two columns of one orderable type. A large-star step links each node's larger neighbours to its smallest
    neighbour, a small-star step its smaller ones; nodes are joined with their minimum, so a node of very many edges
    is one row on one side of a join that adaptive execution splits. Every step starts from a written table. It ends
    when every node has one edge, and that leads to a root: a node of two roots still has to join them.
    """
    a, b = edges.columns
    edges = edges.filter(F.col(a) != F.col(b))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()  # u > v
    edges = written(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minimum(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = _minimum(large)
        small = large.join(low, "u")
        small = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        step = written(small.distinct(), "edges")
        # All edges are stars: no root has an edge of its own, and no node has two roots.
        chained = step.join(step.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        forked = step.groupBy("u").agg(F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        edges = step
        if chained.isEmpty() and forked.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
