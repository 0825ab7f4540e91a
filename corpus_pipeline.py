"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import pipeline_stages as stages
from quarrylight.llm.runtime import new_shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stages.quality),
    ("line_dedup", stages.lines),
    ("minhash_dedup", stages.near_copies),
    ("decontamination", stages.leaks),
    ("bpe_codec", stages.encode),
]

#: No SQL: expectation-maximisation and BPE merges are beyond it. Tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    base = new_shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
