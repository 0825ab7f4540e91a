"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe_codec, decontamination, line_dedup, minhash_dedup, quality_rules
from quarrylight.llm.runtime import col, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).where("kept").select(*map(col, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others have too; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_chars=10, min_docs=2)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*map(col, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.drop_near_copies(docs, shingle=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of the benchmark's words."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(*map(col, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of token ids for each document."""
    return bpe_codec.encode_digests(docs)
