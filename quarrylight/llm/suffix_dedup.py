"""Exact substring dedup: every byte covered by a `length`-byte string that starts elsewhere too.

Only suffixes at anchors are sorted: a string of `length` bytes keeps, wherever it occurs, the same anchor, the
least hash of its GRAM-byte grams, so equal strings meet in the group of one anchor gram.
In a group the enhanced suffix array of what follows the anchors is scanned with a stack, which yields
the tree of common-prefix intervals; in each interval the order of reversed left contexts tells how far
occurrences extend to the left alike (where they are diverse), so that each interval gives a maximal repeat with
all its occurrences, not only neighbours.

Occurrences with wholly equal contexts are one class, counted and not compared. A group of more than MOST classes is
never gathered: its occurrences are grouped anew by longer strings, halving the range of window places in question; where
even the hull of a range is equal all its windows repeat, and where its core is unique none does.

Equal strings are found by 64-bit hashes of grams and contexts together; extents within groups are compared as
bytes. Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; matches never cross
texts; repeated rows and equal texts lose all that is long enough; rows without an id are handled
like others; columns besides the id and the text are not read; an empty table gives an empty result. Texts are cut into tiles
of TILE bytes when hashed; other steps hold one text at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import kernels as K
from quarrylight.llm.prune import key_bits, may_be
from quarrylight.llm.runtime import col, cut

GRAM, TILE = 100, 1 << 22
#: Classes of one group that are sorted in one task.
MOST = 4096
_LAST = (1 << 63) - 1


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place in it, bytes of context left and right, gram hash, context hash) of the anchors, in tiles."""
    reach = length + GRAM + length
    sizes = np.diff(offsets)
    at = 0
    while at < len(sizes):
        if sizes[at] > TILE:  # a long text alone, in overlapping tiles
            base, n = int(offsets[at]), int(sizes[at])
            for t in range(0, n, TILE):
                lo, hi = max(0, t - reach), min(n, t + TILE + reach)
                _, place, left, right, gram, context = _anchors(data[base + lo : base + hi], np.array([0, hi - lo]), length)
                keep = (place + lo >= t) & (place + lo < t + TILE)
                yield np.full(int(keep.sum()), at), place[keep] + lo, left[keep], right[keep], gram[keep], context[keep]
            at += 1
            continue
        to = at + 1
        while to < len(sizes) and sizes[to] <= TILE and offsets[to + 1] - offsets[at] <= TILE:
            to += 1
        text, *rest = _anchors(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], length)
        yield text + at, *rest
        at = to


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    hashes = K.byte_grams(data, GRAM)
    at = K.winnow_bytes(hashes, GRAM, length - GRAM + 1, offsets)
    text = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(at - offsets[text], length - GRAM)
    right = np.minimum(offsets[text + 1] - at, length)
    context = K.mix(K._ranges(data, at - left, at + right) ^ (left * 1024 + right).astype(K.U64))
    return text, at - offsets[text], left, right, hashes[at], context


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Occurrences:
    """What is known of each occurrence while intervals of the tree are closed, children before parents.

    An interval's occurrences are kept as ranks in the order of reversed left contexts. Joining two sets inserts the smaller into
    the larger; an occurrence extends to the left like its neighbours there at most, so that only neighbours are compared.
    """

    def __init__(self, lefts: list[bytes], length: int, low: int, high: int):
        order = sorted(range(len(lefts)), key=lefts.__getitem__)
        self.lefts, self.of = [lefts[i] for i in order], order
        self.rank = [0] * len(order)
        for r, i in enumerate(order):
            self.rank[i] = r
        self.length, self.low, self.high = length, low, high
        self.reach = [-1] * len(order)
        self.found: list[list[tuple[int, int]]] = [[] for _ in order]

    def _alike(self, r: int, reach: int, least: int) -> None:
        if reach > self.reach[r]:
            self.reach[r] = reach
            if reach >= least:
                self.found[self.of[r]].append((least, reach))

    def join(self, a: list[int], b: list[int], height: int) -> list[int]:
        """Both sets in one, all of whose members have `height` bytes in common from the anchor on."""
        if len(a) < len(b):
            a, b = b, a
        least, most = max(self.low, self.length - height), self.high - 1
        for r in b:
            at = bisect_left(a, r)
            if least <= most:
                for k in (at - 1, at):
                    if 0 <= k < len(a) and (self.reach[r] < most or self.reach[a[k]] < most):
                        reach = min(common_prefix(self.lefts[r], self.lefts[a[k]]), most)
                        self._alike(r, reach, least)
                        self._alike(a[k], reach, least)
            a.insert(at, r)
        return a


def repeated_places(lefts: list[bytes], rights: list[bytes], length: int, low: int, high: int) -> list[list[tuple[int, int]]]:
    """For each occurrence the ranges [x, y] of window places, low <= place < high, at which another has the same window.

    A window at place o takes o bytes before the anchor and length - o from it on. `lefts` are reversed. The stack
    holds the open common-prefix intervals of the sorted right contexts: (common prefix, occurrences so far).
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    known = _Occurrences(lefts, length, low, high)
    stack: list[tuple[int, list[int]]] = []
    for i, this in enumerate(order):
        height = common_prefix(rights[this], rights[order[i + 1]]) if i + 1 < len(order) else -1
        now = [known.rank[this]]
        while stack and stack[-1][0] > height:
            closed, members = stack.pop()
            now = known.join(members, now, closed)
        if stack and stack[-1][0] == height:
            stack[-1] = height, known.join(stack[-1][1], now, height)
        elif height >= 0:
            stack.append((height, now))
    return known.found


def _find(length: int):
    def run(batches):
        for batch in K.slices(batches, "text"):
            texts = K.texts_of(batch.column("text"))
            for text, place, left, right, gram, context in anchors_of(texts.data, texts.offsets, length):
                if len(text):
                    rows = pa.array(text)
                    packed = place.astype(np.int64) << 20 | left << 10 | right
                    yield pa.record_batch([batch.column("did").take(rows), batch.column("th").take(rows), pa.array(packed), pa.array(gram.astype(np.int64)), pa.array(context.astype(np.int64))], ["did", "th", "packed", "gram", "context"])

    return run


def _fetch(batches):
    """The contexts asked for: reversed left part, and right part."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column("data")[i].as_py()
            did, th = batch.column("did")[i].as_py(), batch.column("th")[i].as_py()
            out = []
            for ask in batch.column("asked")[i].as_py():
                place, left, right = ask["packed"] >> 20, ask["packed"] >> 10 & 1023, ask["packed"] & 1023
                out.append({"gram": ask["gram"], "did": did, "th": th, "packed": ask["packed"], "left": data[place - left : place][::-1], "right": data[place : place + right]})
            yield pa.RecordBatch.from_pylist(out, schema=_CONTEXT)


_CONTEXT = pa.schema([("gram", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("packed", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
_SPAN = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_SPAN_SQL = "did bigint, th bigint, a bigint, b bigint"


def _sorted_groups(length: int):
    """Rows sorted by (gram, core, low): a group's rows follow each other, perhaps over several batches."""

    def solve(group: list[dict]) -> list[dict]:
        places = repeated_places([x["left"] for x in group], [x["right"] for x in group], length, group[0]["low"], group[0]["high"])
        return [{"did": x["did"], "th": x["th"], "a": (x["packed"] >> 20) - high, "b": (x["packed"] >> 20) - low + length} for x, found in zip(group, places, strict=True) for low, high in found]

    def run(batches):
        group, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k = row["gram"], row["core"], row["low"], row["high"]
                if k != key:
                    if len(group) > 1:
                        out += solve(group)
                    group, key = [], k
                group.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_SPAN)
        if len(group) > 1:
            yield pa.RecordBatch.from_pylist(solve(group), schema=_SPAN)

    return run


def _removed(bits=None):
    """Sizes and digests after removal; with a bitmap, of texts without spans that aren't in it."""

    def run(batches):
        for batch in K.slices(batches, "data"):
            if bits is not None:
                batch = batch.filter(pa.array(~may_be(bits.value, batch.column("th").to_numpy(zero_copy_only=False))))
            out = []
            whole = batch.schema.names[-1] == "bytes_too"
            spans_of = batch.column("spans").to_pylist() if bits is None else [None] * batch.num_rows
            for data, spans in zip(batch.column("data"), spans_of, strict=True):
                data = data.as_py()
                runs: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if runs else data
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if whole else None))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * whole
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * whole])

    return run


def repeated_spans(source: DataFrame, length: int = 400, most: int = MOST) -> DataFrame:
    """did, th, a, b: byte ranges of texts that repeated strings cover; they overlap. `source` has did, th and text."""
    find = source.mapInArrow(_find(length), "did bigint, th bigint, packed bigint, gram bigint, context bigint")
    twice = cut(find.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    found = cut(find.join(twice, "gram"))

    classes = cut(found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "th", "packed")).alias("one")))
    place, left, right = F.shiftright("packed", 20), F.shiftright("packed", 10).bitwiseAND(1023), F.col("packed").bitwiseAND(1023)
    whole = found.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"]).where(left + right >= length)
    spans = whole.select("did", "th", (place - left).alias("a"), (place + right).alias("b"))

    several = cut(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"))  # joins with it can be split by skew
    asked = classes.join(several, "gram").select("gram", "one.*", "classes")
    per_text = cut(asked.groupBy("did", "th").agg(F.collect_list(F.struct("gram", "packed")).alias("asked")))
    contexts = _texts(source, key_bits(per_text, "th")).select("did", "th", "text").join(per_text, ["did", "th"]).select("did", "th", F.coalesce("text", F.lit("")).cast("binary").alias("data"), "asked").mapInArrow(_fetch, _CONTEXT_SQL)
    sized = contexts.join(several, "gram").select("gram", "did", "th", "packed", "left", "right", "classes", F.lit(0).cast("long").alias("core"), F.lit(0).alias("low"), F.lit(length - GRAM + 1).alias("high"))
    sized = cut(sized)
    spans = spans.unionByName(_solved(sized.where(F.col("classes") <= most), length))

    big = sized.where(F.col("classes") > most)
    while big.take(1):
        done, small, big = _halved(big, length, most)
        spans = spans.unionByName(done).unionByName(_solved(small, length))
    return spans


def _texts(source: DataFrame, bits) -> DataFrame:
    """Rows whose text's hash may be in the bitmap: rows without a partner needn't be moved."""

    def run(batches):
        for batch in K.slices(batches, "text"):
            keep = may_be(bits.value, batch.column("th").to_numpy(zero_copy_only=False))
            if keep.any():
                yield batch if keep.all() else batch.filter(pa.array(keep))

    return source.mapInArrow(run, source.schema)


_CONTEXT_SQL = "gram bigint, did bigint, th bigint, packed bigint, left binary, right binary"


def _solved(groups: DataFrame, length: int) -> DataFrame:
    rows = groups.select("gram", "core", "low", "high", "did", "th", "packed", "left", "right").repartition("gram", "core", "low").sortWithinPartitions("gram", "core", "low")
    return rows.mapInArrow(_sorted_groups(length), _SPAN_SQL)


def _halved(big: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, small groups, groups still too big) after halving the ranges of places [low, high) of occurrences."""
    middle = "cast((low + high) div 2 as int)"
    halves = big.drop("classes").withColumn("half", F.explode(F.expr(f"filter(array(struct(low as low, {middle} as high), struct({middle} as low, high as high)), x -> x.low < x.high)")))
    halves = halves.select("gram", "did", "th", "packed", "left", "right", "half.*")
    # The core is in all windows of the range: low bytes before the anchor, length + 1 - high from it on; the hull holds them all.
    inside = (F.length("left") >= F.col("low")) & (F.length("right") >= length + 1 - F.col("high"))
    within = (F.length("left") >= F.col("high") - 1) & (F.length("right") >= length - F.col("low"))
    cores = halves.where(inside).withColumn("core", F.expr(f"xxhash64(gram, low, high, substring(left, 1, low), substring(right, 1, {length + 1} - high))"))
    cores = cores.withColumn("hull", F.when(within, F.expr(f"xxhash64(7, gram, low, high, substring(left, 1, high - 1), substring(right, 1, {length} - low))")))
    cores = cut(cores)
    hulls = cores.where("hull is not null").groupBy("gram", "low", "hull").agg(F.count(F.lit(1)).alias("alike")).where("alike > 1")
    counts = cores.groupBy("gram", "low", "core").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    known = cut(cores.join(hulls, ["gram", "low", "hull"], "left").join(counts, ["gram", "low", "core"]))
    place = F.shiftright("packed", 20)
    done = known.where("alike is not null").select("did", "th", (place - F.col("high") + 1).alias("a"), (place - F.col("low") + length).alias("b"))
    names = ["gram", "did", "th", "packed", "left", "right", "classes", "core", "low", "high"]
    # Those with a twin are partners of the others still, but one of each set of twins is enough.
    alone = known.where("alike is null").select(*names)
    twins = known.where("alike is not null").groupBy("gram", "low", "hull").agg(F.first(F.struct(*names)).alias("x")).select("x.*")
    open_keys = alone.select("gram", "low", "core").distinct()
    left_over = alone.unionByName(twins.join(open_keys, ["gram", "low", "core"], "left_semi"))
    sizes = left_over.groupBy("gram", "low", "core").agg(F.count(F.lit(1)).alias("size"))
    left_over = cut(left_over.drop("classes").join(sizes.withColumnRenamed("size", "classes"), ["gram", "low", "core"]).where("classes > 1").select(*names))
    single = left_over.where((F.col("classes") > most) & (F.col("high") - F.col("low") > 1))
    return done, left_over.where((F.col("classes") <= most) | (F.col("high") - F.col("low") <= 1)), single


def remove_repeats(docs: DataFrame, *, length: int = 400, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", bytes_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256, with kept_bytes if asked for."""
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(id_col), F.lit(_LAST)).alias("did"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"), col(text_col).alias("text"))
    spans = cut(repeated_spans(source, length, most).groupBy("did", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    bits = key_bits(spans, "th")
    fields = [source.schema["doc_id"], *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept_bytes", T.BinaryType())] * bytes_too]
    data, more = F.coalesce("text", F.lit("")).cast("binary").alias("data"), [F.lit(True).alias("bytes_too")] * bytes_too
    hit = _texts(source, bits).join(spans, ["did", "th"], "left").select("doc_id", data, "spans", *more).mapInArrow(_removed(), T.StructType(fields))
    return hit.unionByName(source.select("doc_id", "th", data, *more).mapInArrow(_removed(bits), T.StructType(fields)))
