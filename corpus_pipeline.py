"""The corpus pipeline: quality, toxicity, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read back as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import line_dedup, packing, quality, simhash, toxicity
from docloom.session import materialize, ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go."""
    ship(spark)
    return quality.keep(docs, quality.train(docs, _labels(spark, sf_dir)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the documents of this stage."""
    ship(spark)
    return toxicity.keep(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal lines the first one stays; no document goes."""
    return line_dedup.drop_lines(docs)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar by 0.8 or more, one stays."""
    ship(spark)
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_filter),
    ("near_duplicates", near_duplicate_filter),
    ("packing", packed),
]

#: The classifiers and the fingerprints can't be expressed in SQL; tests/llm holds a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
