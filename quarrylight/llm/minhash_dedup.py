"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation of the 32-bit universe scatters the shingles, a second one, shifted by 0, 1, 2 ...
places, gives all signature coordinates. Documents with equal shingle sets form one
class; only classes go on. Classes that agree on a band share a bucket. In each bucket one class leads,
the one whose own buckets are largest (the middle of a group of near copies), and every
other is verified against it on full sets: as many pairs as members. What then still
lies in several components of a bucket is compared in blocks: the members outside the bucket's largest
component as queries against the whole bucket, on full sets. Only links leave these tasks; no pair of
different components of a bucket is left out.

Signatures err: with 64 coordinates, links exactly at the threshold meet in no bucket with probability
under 1e-5 (bands of 4 rows at 0.85 or more, else of 3). Every reported link is exact.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a text with
fewer words than a shingle has all its words as one; repeated rows are one class; rows without an id join
classes like others, but a component's id is the smallest id that is not null, or null, and then all its rows are kept;
rows are dropped by id and text, so that others without an id or under the same id stay;
columns besides the id and the text are not read by near_copies; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import kernels as K
from quarrylight.llm.components import components
from quarrylight.llm.runtime import col, cut, fresh

COORDINATES = 64
#: Shingles in one block of a bucket's comparison, about.
BLOCK = 1 << 16
_LAST = (1 << 63) - 1


def shingle_sets(words: K.Words, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes."""
    hashes = K.grams(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        else:
            out.append(K.grams(words.hash[a:b], b - a) if b > a else np.zeros(0, dtype=K.U64))
    return out


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, after folding 64-bit shingles to 32 bits."""
    return (K.mix(x ^ K.U64(0xA5A5F00D12345678)) >> K.U64(32)).astype(np.uint32)


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection on 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES columns for each set that isn't empty; rows of empty sets are all ones."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        items = scatter(np.concatenate([sets[i] for i in full]))
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat(permute(items + np.uint32(k)), starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    n = COORDINATES // rows
    keys = np.empty((len(signature), n), dtype=K.U64)
    for b in range(n):
        x = K.mix(np.full(len(signature), b + 1, dtype=K.U64))
        for r in range(rows):
            x = K.mix(x + signature[:, b * rows + r].astype(K.U64) * K.U64(0xD6E8FEB86659FD93) + K.U64(r))
        keys[:, b] = x
    return keys


def _marks(shingle: int, rows: int):
    """Of each row its id, number of shingles, class (two sums of hashes over its set) and bands."""

    def run(batches):
        for batch in K.slices(batches, "text"):
            sets = shingle_sets(K.Words(K.texts_of(batch.column("text"))), shingle)
            sig = signatures(sets)
            keys = bands(sig, rows).astype(np.int64)
            sums = [[int(K.mix(s ^ K.U64(salt)).sum(dtype=K.U64).astype(np.int64)) if len(s) else None for s in sets] for salt in (0x1234567, 0x89ABCDEF01)]
            flat = pa.array(keys.ravel())
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "did", "th")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[0], pa.int64()),
                    pa.array(sums[1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), flat),
                ],
                ["doc_id", "did", "th", "n_shingles", "ca", "cb", "bands"],
            )

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in K.slices(batches, "text"):
            sets = shingle_sets(K.Words(K.texts_of(batch.column("text"))), shingle)
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).astype(np.int64) if ends[-1] else np.zeros(0, dtype=np.int64)
            yield pa.record_batch([batch.column("ca"), batch.column("cb"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["ca", "cb", "items"])

    return run


def _compare(percent: int):
    """Of each pair of blocks the links between members of different components, from full sets."""

    def block(rows: pa.StructArray):
        ca, cb, la, lb, items = rows.flatten()
        ends = items.offsets.to_numpy()
        ids = np.stack([x.to_numpy() for x in (ca, cb, la, lb)], axis=1)
        return ids, np.diff(ends), items.values.to_numpy()[ends[0] : ends[-1]]

    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                a, a_sizes, a_items = block(batch.column("queries")[row].values)
                b, b_sizes, b_items = block(batch.column("members")[row].values)
                common = intersections(a_items, a_sizes, b_items, b_sizes)
                union = a_sizes[:, None] + b_sizes[None, :] - common
                apart = (a[:, None, 2] != b[None, :, 2]) | (a[:, None, 3] != b[None, :, 3])
                for i, j in zip(*np.nonzero(apart & (100 * common >= percent * union)), strict=True):
                    p, q = sorted(((int(a[i, 0]), int(a[i, 1])), (int(b[j, 0]), int(b[j, 1]))))
                    out.append({"a": {"ca": p[0], "cb": p[1]}, "b": {"ca": q[0], "cb": q[1]}})
            yield pa.RecordBatch.from_pylist(out, schema=_PAIR)

    return run


def intersections(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, columns: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another, by products of 0/1 matrices over what both have."""
    shared = np.intersect1d(a, b)
    out = np.zeros((len(a_sizes), len(b_sizes)), dtype=np.int64)
    if not len(shared):
        return out
    places = []
    for items, sizes in ((a, a_sizes), (b, b_sizes)):
        at = np.minimum(np.searchsorted(shared, items), len(shared) - 1)
        known = shared[at] == items
        places.append((np.repeat(np.arange(len(sizes)), sizes)[known], at[known], len(sizes)))
    for first in range(0, len(shared), columns):
        width = min(columns, len(shared) - first)
        parts = []
        for row, at, n in places:
            inside = (at >= first) & (at < first + width)
            part = np.zeros((n, width), dtype=np.float32)
            part[row[inside], at[inside] - first] = 1
            parts.append(part)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


_NODE = pa.struct([("ca", pa.int64()), ("cb", pa.int64())])
_PAIR = pa.schema([("a", _NODE), ("b", _NODE)])
_PAIR_SQL = "a struct<ca: bigint, cb: bigint>, b struct<ca: bigint, cb: bigint>"


def near_copies(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hash_too: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row, with th, the text's hash, if asked for.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets. A row is kept if its
    id is the smallest of its component.
    """
    rows = 4 if percent >= 85 else 3
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(id_col), F.lit(_LAST)).alias("did"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"), col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(k, T.LongType()) for k in ("did", "th", "n_shingles", "ca", "cb")), T.StructField("bands", T.ArrayType(T.LongType()))]
    marks = cut(source.mapInArrow(_marks(shingle, rows), T.StructType(fields))).withColumn("c", F.when(F.col("ca").isNotNull(), F.struct("ca", "cb")))

    classes = marks.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(F.struct("did", "th")).alias("at"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    member = classes.select("c", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = cut(member.join(shared, "key"))

    # Sets of the classes that share a bucket, from one row of each.
    met = classes.join(member.select("c").distinct(), "c", "left_semi").select("c", "at.did", "at.th", "n")
    texts = source.select("did", "th", "text").join(met.select("did", "th", F.col("c.ca").alias("ca"), F.col("c.cb").alias("cb")), ["did", "th"])
    sets = texts.select("ca", "cb", "text").mapInArrow(_sets(shingle), "ca bigint, cb bigint, items array<bigint>")
    sets = cut(sets.groupBy(F.struct("ca", "cb").alias("c")).agg(F.first("items").alias("items")))

    # Every member of a bucket against its leader.
    weight = member.groupBy("c").agg(F.sum("size").alias("weight"))
    weighed = member.join(weight, "c")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "c")).alias("top")).select("key", F.col("top.c").alias("leader"))
    first = weighed.join(leaders, "key").where("c <> leader").select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b")).distinct()
    links = cut(_verified(first, sets, percent))
    labels = components(links)

    # Members outside their bucket's largest component against the whole bucket, in blocks.
    labelled = member.drop("size").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c")).join(met.select("c", "n"), "c")
    per = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("items"))
    mixed = per.groupBy("key").agg(F.max(F.struct("members", "label")).alias("most"), F.sum("members").alias("all"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("labels")).where("labels > 1 and all > 2")
    rest = labelled.join(mixed.select("key", F.col("most.label").alias("main"), F.col("items").alias("in_bucket")), "key").join(sets, "c")
    blocks = rest.select("key", "main", F.expr(f"cast(pmod(xxhash64(c), ceil(in_bucket / {BLOCK})) as int)").alias("block"), "label", F.struct(F.col("c.ca").alias("ca"), F.col("c.cb").alias("cb"), F.col("label.ca").alias("la"), F.col("label.cb").alias("lb"), "items").alias("x"))
    queries = blocks.where("label <> main").groupBy("key", "block").agg(F.collect_list("x").alias("queries")).drop("block")
    members = blocks.groupBy("key", "block").agg(F.collect_list("x").alias("members")).drop("block")
    more = cut(queries.join(members, "key").select("queries", "members").mapInArrow(_compare(percent), _PAIR_SQL).distinct())
    if more.take(1):
        labels = components(links.unionByName(more))

    ids = classes.select("c", "least")
    roots = labels.withColumnRenamed("node", "c").join(ids, "c")
    smallest = roots.groupBy("label").agg(F.min("least").alias("component"))
    of_class = ids.join(roots.select("c", "label"), "c", "left").join(smallest, "label", "left").select("c", F.coalesce("component", "least").alias("component"))
    th = ["th"] * hash_too
    out = marks.select("doc_id", "n_shingles", "c", *th).join(of_class, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *th).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("items").alias("left")), "a").join(sets.select(F.col("c").alias("b"), F.col("items").alias("right")), "b")
    least = F.least(F.size("left"), F.size("right"))
    both = both.where(100 * least >= percent * F.greatest(F.size("left"), F.size("right")))
    common = F.size(F.array_intersect("left", "right"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("left") + F.size("right") - F.col("common"))).select("a", "b")


def drop_near_copies(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that near_copies keeps, all columns unchanged; rows are told apart by id and text."""
    gone, copy = fresh(docs, "gone", "copy")
    found = near_copies(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col, hash_too=True).where("not kept")
    dropped = found.select(F.coalesce("doc_id", F.lit(_LAST)).alias(gone), F.col("th").alias(copy)).distinct()
    same = (F.coalesce(docs[id_col], F.lit(_LAST)) == F.col(gone)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(copy))
    return docs.join(dropped, same, "left_anti")
