"""Which keys may be in a table: a bitmap of fixed size, so that rows without a partner stay where they are.

A bit that is set only says that the key may be there; joins still decide. The bitmap has at most 8 MB whatever the table's
size (with very many keys most bits are set, and more rows move), so it can go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def key_bits(keys: DataFrame, name: str) -> Broadcast:
    """The bitmap of the low bits of a column of 64-bit hashes, as a broadcast array; nulls set none."""
    place = F.expr(f"{name} & {(1 << BITS) - 1}L") + 1
    rows = keys.where(F.col(name).isNotNull()).select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = np.zeros(1 << BITS - 3, dtype=np.uint8)
    for row in rows.toLocalIterator():
        at = (row["b"] - 1) * len(row["bits"])
        out[at : at + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def may_be(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the table."""
    place = keys & (1 << BITS) - 1
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def without_repeats(batches: Iterator[pa.RecordBatch], name: str, bits: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """Rows whose key (a 64-bit hash) this task has not met before and which may be in `bits`, if given."""
    met: set[int] = set()
    for batch in batches:
        keys = batch.column(name).to_numpy(zero_copy_only=False)
        keep = []
        for i in np.flatnonzero(may_be(bits.value, keys)).tolist() if bits is not None else range(len(keys)):
            key = int(keys[i])
            if key not in met:
                met.add(key)
                keep.append(i)
        if len(keep) == len(keys):
            yield batch
        elif keep:
            yield batch.take(pa.array(keep))
