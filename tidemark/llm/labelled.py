"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import folds, written


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], limit: int) -> DataFrame:
    """At most `limit` rows (text, label) of labelled documents outside the held-out fold, as a written table.

    The rows of the smallest hashes of doc_id are taken: the same rows whatever the partitioning. At most `limit` ids are
    broadcast. Rows with a null id, text or label are left out, and of equal texts with equal labels one is used.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~folds("doc_id", *fold)
    )
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
    return written(rows.dropDuplicates(["text", "label"]), f"sample-{label}")
