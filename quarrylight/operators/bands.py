"""Score bands: rows whose scores follow each other within a gap count as tied, and go by tie-breakers.

Bands are numbered over ranges of the score: each range numbers its own, and what it needs of the ranges before (their last score and
how many bands they hold) is one row for each. No task sees more than one range, however long a band is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import shared

# Fixed value: scores within this of each other are tied.
GAP = 0.02


def banded(rows: DataFrame, score: str, gap: float = GAP) -> DataFrame:
    """The rows with band: 1 for the highest scores; a new band begins where the next score is lower by more than the gap.

    Gaps are compared to nine digits. Null scores come last, in a band of their own.
    """
    shared.folder(rows.sparkSession)
    order = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    ranged = rows.withColumn("__s", order).repartitionByRange(F.desc("__s")).withColumn("__part", F.spark_partition_id()).checkpoint()
    parts = ranged.groupBy("__part").agg(F.min("__s").alias("low"))
    before = Window.orderBy("__part")  # a row for each range
    ends = parts.select("__part", F.lag("low").over(before).alias("__last"))
    inside = Window.partitionBy("__part").orderBy(F.desc("__s"))
    fall = F.round(F.coalesce(F.lag("__s").over(inside), F.col("__last")) - F.col("__s"), 9)
    marked = ranged.join(F.broadcast(ends), "__part").withColumn("__new", (F.isnan(fall) | (fall > gap)).cast("long")).withColumn("__new", F.coalesce("__new", F.lit(0)))
    marked = marked.withColumn("__new", F.when(F.col("__s") == float("-inf"), F.when(fall == float("inf"), 1).otherwise(0)).otherwise(F.col("__new")))
    sums = marked.groupBy("__part").agg(F.sum("__new").alias("own"))
    offsets = sums.select("__part", F.coalesce(F.sum("own").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    so_far = F.sum("__new").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = marked.join(F.broadcast(offsets), "__part").withColumn("band", so_far + F.col("__offset") + 1)
    return out.select(*rows.columns, "band")


def ranked(rows: DataFrame, score: str, ties: list[Column], gap: float = GAP) -> DataFrame:
    """The rows by band, then tie-breakers; a global sort, which Spark does in ranges too."""
    return banded(rows, score, gap).orderBy("band", *ties)


def tie_breakers(exact_symbol: str = "is_exact", file_type: str = "file_type", length: str = "line_count", degree: str = "degree") -> list[Column]:
    """Exact symbol matches first, then sources before tests, shorter files, and files with more edges."""
    return [F.desc(exact_symbol), (F.col(file_type) == "test").asc(), F.col(length).asc_nulls_last(), F.col(degree).desc_nulls_last()]
