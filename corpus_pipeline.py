"""The corpus pipeline: quality, toxicity, exact and near duplicates, and packing, stage by stage.

Each stage takes what its predecessor kept. The classifiers learn from the labels and documents in `sf_dir`, so that their
decisions do not depend on what came before.

All stages but the last return whole rows with the columns of their input, whatever other columns there are. Null texts count as
empty, texts are taken whole, a repeated row is a row like others, and an empty table stays empty. Without labels of a kind nothing is
rejected for it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, packing, quality, simhash_dedup, toxicity
from tidemark.llm.common import fresh, table, written

#: Scores from which a document counts as good, and as toxic.
GOOD, TOXIC = 0.3, 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are one passage without features, and scored as such."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh("quality_score", docs)
    return quality.score(docs, model, name).filter(F.col(name) >= GOOD).drop(name)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject. Null and empty texts match nothing and stay."""
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh("toxicity_score", docs)
    return toxicity.score(docs, lexicon, name).filter(F.col(name) < TOXIC).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the largest id; a null id only if there is no other. Of repeated rows one stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one of the smallest id, and of its texts that of the smallest fingerprint;
    a null id only if there is no other. Of repeated rows one stays."""
    return simhash_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens. Null and empty texts are one end token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: The classifiers are trained and the packing is a search: tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
