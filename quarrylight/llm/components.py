"""Connected components by alternating large-star and small-star rounds, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.runtime import cut


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of `links` (columns a and b).

    Each round replaces links by links to smaller nodes, so that components become stars; no neighbourhood is
    gathered in a task (minima are aggregated, then joined back), and each round's links are written to
    the shared folder. Links with a null end and loops are ignored.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    sign = _sign(pairs)
    while sign[0]:
        both = pairs.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        pairs = cut(small.unionByName(lows.select("u", F.col("low").alias("v"))).distinct())
        before, sign = sign, _sign(pairs)
        if sign == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _sign(pairs: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
