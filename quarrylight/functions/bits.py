"""Which rows may have a partner, by bits of their keys: only these need to move for a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def may_match(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose values of `names` may be among those of `keys`; a join with them still decides.

    What is broadcast is bounded: words of 64 bits, 2 ** BITS bits at most. With very many keys most bits are set, and more rows stay.
    """
    place, bit = F.xxhash64(*names).bitwiseAND((1 << BITS) - 1), F.expr("cast(__place & 63 as int)")
    word = F.expr("cast(shiftright(__place, 6) as int)")
    words = keys.select(place.alias("__place")).groupBy(word.alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__place & 63 as int))")).alias("__bits"))
    found = rows.withColumn("__place", place).withColumn("__of", word).join(F.broadcast(words), F.col("__of") == F.col("__word"))
    return found.where(F.getbit("__bits", bit) == 1).select(*rows.columns)
