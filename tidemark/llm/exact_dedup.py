"""Exact deduplication by skew-safe combining.

Three stages combine equal contents, and each groups by the content itself, never by its digest alone:

1. locally: the partial aggregate leaves one row per content and input partition;
2. by salt: rows of one digest meet in `salts` groups, by the partition they came from;
3. globally: the winners of the salts meet.

Whatever share of the rows is one text, stage 2 gets at most a row per input partition and stage 3 a row per salt.
Documents are then led back to their class by digest; a digest with several contents is resolved by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, body, keep_id, group_size) of rows (doc_id, digest, body)."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Equal are texts with the same normal form; of those the largest id stays. Null text counts as empty, so empty
    texts form one class. Null ids lose against any id; a class of null ids only has keep_id null and keeps one row.
    A row repeated with its id counts in group_size each time, and one of the repetitions stays. Other columns are
    not read, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), normalise(F.col(text_column)).alias("body"))
    rows = rows.select("doc_id", digest(F.col("body")).alias("digest"), "body")
    by_digest = _winners(rows, salts).groupBy("digest")
    classes = written(
        by_digest.agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("bodies")
        ),
        "exact-dedup",
    )
    members = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    joined = members.join(classes.filter("bodies = 1").drop("bodies"), "digest")
    collided = classes.filter("bodies > 1").select("digest")
    if not collided.isEmpty():
        unclear = rows.join(collided, "digest", "left_semi")
        exact = unclear.groupBy("doc_id", "digest", "body").agg(F.count(F.lit(1)).alias("times"))
        exact = exact.join(_winners(unclear, salts), ["digest", "body"]).drop("body")
        joined = joined.unionByName(exact)
    first = F.col("turn") == 1
    return joined.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        "digest",
    )


def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """The whole rows of `docs` that stay, one for each class of equal texts; null ids as in `exact_dedup`.

    All columns are kept, whatever their names. Of a row that is repeated with its id, one repetition stays.
    """
    found = exact_dedup(docs, id_column, text_column, normalise, digest, salts)
    own = fresh("digest_of_row", docs)
    rows = docs.withColumn(own, digest(normalise(F.col(text_column))))
    kept_id, kept_digest = fresh("kept_id", rows), fresh("kept_digest", rows)
    decided = written(found.withColumnsRenamed({"doc_id": kept_id, "digest": kept_digest}), "kept")
    same = rows[id_column].eqNullSafe(F.col(kept_id)) & (rows[own] == F.col(kept_digest))
    stay = rows.join(decided.filter("kept"), same, "left_semi")
    repeated = decided.filter(~F.col("kept") & F.col(kept_id).eqNullSafe(F.col("keep_id")))
    if not repeated.isEmpty():
        several = stay.join(repeated, same, "left_semi").dropDuplicates([id_column, own])
        stay = stay.join(repeated, same, "left_anti").unionByName(several)
    return stay.drop(own)
