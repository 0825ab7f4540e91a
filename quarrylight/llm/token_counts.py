"""Exact token counts from prefix tables (prefix dynamic programming).

For every text the table entry at a prefix is the token count of that prefix, so that
truncation and budget questions are answered by looking up entries; nothing is encoded
again. The tables of pieces are remembered in each worker (bpe.MEMO pieces at most).

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are handled one by one,
so nulls in the id, repeated rows and ties give one result row each; columns besides the id and
the text are not read, whatever they are called; an empty table gives an empty result. Text is
never cut: memory of a task grows with its longest text.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import bpe
from quarrylight.llm.runtime import col


def token_counts(docs: DataFrame, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row: the whole text's prefix-table entry."""
    path = vocabulary or bpe.default_path()

    def run(batches):
        model = bpe.load(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [model.count(x) for x in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return source.mapInArrow(run, _schema(source, n_bytes=T.LongType(), n_tokens=T.LongType(), over_limit=T.BooleanType()))


def prefix_tables(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and the token counts of all prefixes of its text, by code points, from 0 up to the text."""
    path = vocabulary or bpe.default_path()

    def run(batches):
        model = bpe.load(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.prefix_counts(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "counts"])

    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return source.mapInArrow(run, _schema(source, counts=T.ArrayType(T.LongType())))


def truncated(docs: DataFrame, budget: int, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, kept_chars and n_tokens: the longest prefix of at most `budget` tokens.

    Counts can fall as a prefix grows (a merge swallows tokens); the longest of all prefixes
    that fit is taken.
    """
    path = vocabulary or bpe.default_path()

    def run(batches):
        model = bpe.load(path)
        for batch in batches:
            kept = []
            for x in batch.column(1).to_pylist():
                counts = model.prefix_counts(x or "")
                least = counts[:]
                for i in range(len(least) - 2, -1, -1):
                    least[i] = min(least[i], least[i + 1])
                at = bisect_right(least, budget) - 1
                kept.append((at, counts[at]) if at >= 0 else (0, 0))
            yield pa.record_batch([batch.column(0), pa.array([k for k, _ in kept], pa.int64()), pa.array([n for _, n in kept], pa.int64())], ["doc_id", "kept_chars", "n_tokens"])

    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return source.mapInArrow(run, _schema(source, kept_chars=T.LongType(), n_tokens=T.LongType()))


def within_budget(counted: DataFrame, budget: int) -> DataFrame:
    """Rows of token_counts whose running total in order of doc_id, n_tokens is at most `budget`.

    The totals of ranges come first, so that no task sees all rows.
    """
    if not counted.take(1):
        return counted.withColumn("total", F.lit(0).cast("long"))
    from pyspark.sql import Window

    spread = counted.repartitionByRange("doc_id", "n_tokens").withColumn("part", F.spark_partition_id())
    sums = spread.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("inside", inside).join(before, "part").withColumn("total", F.col("inside") + F.col("before")).where(F.col("total") <= budget).drop("part", "inside", "before")


def _schema(source: DataFrame, **more) -> T.StructType:
    return T.StructType([source.schema["doc_id"], *(T.StructField(k, v) for k, v in more.items())])
