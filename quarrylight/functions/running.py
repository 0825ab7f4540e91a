"""Running totals over all rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def running_total(df: DataFrame, key: str, values: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """The rows with the total of each value over all rows up to theirs in order of a numeric key without repetitions.

    Rows are dealt by approximate quantiles of the key (`parts` numbers on the driver); each part sums its own rows, and a
    table of one row for each part adds what comes before.
    """
    cuts = df.select(F.percentile_approx(key, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(10_000))).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    dealt = df.withColumns({f"__v_{k}": v.cast("long") for k, v in values.items()}).withColumn("__part", F.size(F.filter(bounds, lambda b: b < F.col(key))))
    sums = dealt.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__part", *(F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__b_{k}") for k in values))
    inside = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "__part")  # `parts` rows at most
    return out.select(*(F.col(c) for c in df.columns), *((F.sum(f"__v_{k}").over(inside) + F.col(f"__b_{k}")).alias(k) for k in values))
