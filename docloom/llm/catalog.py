"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, bytebpe, flac, license_scan, line_dedup, packing, quality, simhash, toxicity, url_filter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each hundredth one."""
    return ann.search(_t(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens laid out in windows, with lexical neighbours."""
    return packing.pack(_t(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.license_scan(_t(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids, encoded and decoded."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.digests(_t(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and fate of every line of every document."""
    return line_dedup.line_classes(_t(spark, sf_dir, "documents")).drop("id", "mark")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as FLAC, read back and described."""
    return flac.media_digests(_t(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.url_verdicts(_t(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_ann, op3_simhash, op4_packing, op5_license_scan, op6_byte_bpe, op7_quality, op8_line_dedup, op9_flac, op10_url_filter]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
