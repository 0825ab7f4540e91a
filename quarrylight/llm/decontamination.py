"""Benchmark decontamination by winnowing.

Both sides keep the least 5-word-gram hash of every 6 consecutive ones, so that any shared span of 10 words
shares a kept fingerprint. Where fingerprints meet, the hit is extended to the 10-word windows around it, and these are
compared. Items shorter than a window are one window; grams of just their lengths are looked up as well.

The benchmark's windows are counted first. Up to MOST_WINDOWS they are sent to the executors and documents are
scanned once, without a shuffle; windows are then compared word by word. Beyond it, fingerprints and then windows are joined by
shuffles, windows as two 64-bit hashes.

Defined results: null or blank texts have no words and are not hit; items without words are ignored; items
with equal ids count as one; rows are handled one by one, so nulls in the id and repeated rows give one
result row each; columns besides the id and the text are only carried along; empty tables on either
side give no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import kernels as K
from quarrylight.llm.runtime import col, cut, fresh

WINDOW, GRAM = 10, 5
#: Benchmark windows that are broadcast at most (about 100 bytes each).
MOST_WINDOWS = 200_000
_LAST = (1 << 63) - 1
_RESULTS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def fingerprints(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams."""
    hashes = K.grams(words.hash, GRAM)
    at = K.winnow(hashes, WINDOW - GRAM + 1, K.owners(words.first), GRAM)
    return at, hashes[at]


def window_text(words: K.Words, at: int, n: int) -> bytes:
    """n words from `at`, lower-cased, with single spaces."""
    return b" ".join(words.lower[a:b].tobytes() for a, b in zip(words.start[at : at + n].tolist(), words.end[at : at + n].tolist(), strict=True))


def _benchmark_windows(batches):
    """A row for each window of each item: its length, text, two hashes, and whether its fingerprint."""
    for batch in K.slices(batches, "text"):
        words = K.Words(K.texts_of(batch.column("text")), K.NOT_ALNUM)
        out = []
        for i, item in enumerate(batch.column("item").to_pylist()):
            a, b = int(words.first[i]), int(words.first[i + 1])
            n = min(WINDOW, b - a)
            if n and item is not None:
                h = [K.grams(words.hash[a:b], n, seed).astype(np.int64) for seed in (0, 1)]
                out += [{"item": item, "n": n, "text": window_text(words, a + k, n), "h1": int(h[0][k]), "h2": int(h[1][k])} for k in range(b - a - n + 1)]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.string()), ("n", pa.int32()), ("text", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())]))


class _Known:
    """The benchmark as the executors have it."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        for item, _, text in rows:
            self.items.setdefault(text, []).append(item)
        self.items = {k: sorted(set(v)) for k, v in self.items.items()}
        long = [text for _, n, text in rows if n == WINDOW]
        words = K.Words(K.texts_of(pa.array(long, pa.binary())), K.NOT_ALNUM)
        _, prints = fingerprints(words)
        self.prints = np.unique(prints)
        self.windows = np.unique(K.grams(words.hash, WINDOW)[words.first[:-1]]) if long else np.zeros(0, dtype=K.U64)
        self.short: dict[int, np.ndarray] = {}
        for n in sorted({n for _, n, _ in rows if n < WINDOW}):
            words = K.Words(K.texts_of(pa.array([t for _, m, t in rows if m == n], pa.binary())), K.NOT_ALNUM)
            self.short[n] = np.unique(K.grams(words.hash, n)[words.first[:-1]])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def candidates(words: K.Words, prints: np.ndarray, short) -> list[tuple[int, np.ndarray]]:
    """(length, starts) of the windows to compare: those around fingerprint hits, and grams of the short lengths."""
    at, hashes = fingerprints(words)
    at = at[_among(hashes, prints)]
    fit = K.within(words.first, WINDOW)
    starts = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
    starts = starts[(starts >= 0) & (starts < len(fit))]
    out = [(WINDOW, starts[fit[starts]])]
    for n, known in short.items():
        inside = K.within(words.first, n)
        out.append((n, np.flatnonzero(inside if known is None else inside & _among(K.grams(words.hash, n), known))))
    return out


def _scan(known, kept: list[str], text_at: int):
    def run(batches):
        bench = known.value
        for batch in K.slices(batches, "text" if text_at < 0 else kept[text_at]):
            column = batch.column(text_at if text_at >= 0 else batch.num_columns - 1)
            words = K.Words(K.texts_of(column), K.NOT_ALNUM)
            hit = np.zeros(len(words) + 1, dtype=np.int64)
            found: dict[int, set[str]] = {}
            for n, starts in candidates(words, bench.prints, bench.short):
                if n == WINDOW:
                    starts = starts[_among(K.grams(words.hash, WINDOW)[starts], bench.windows)]
                rows = np.searchsorted(words.first, starts, side="right") - 1
                for at, row in zip(starts.tolist(), rows.tolist(), strict=True):
                    if items := bench.items.get(window_text(words, at, n)):
                        hit[at] += 1
                        hit[at + n] -= 1
                        found.setdefault(row, set()).update(items)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
            n_hit = covered[words.first[1:]] - covered[words.first[:-1]]
            rows = range(batch.num_rows)
            yield pa.record_batch(
                [
                    *(batch.column(i) for i in range(len(kept))),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(found.get(i, ())) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(found.get(i, ()))).encode()).hexdigest() for i in rows], pa.string()),
                    pa.array(n_hit > 0),
                ],
                [*kept, *(k for k, _ in _RESULTS)],
            )

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, *, carry: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The columns `carry` (all if None) with n_words, n_hit, n_items, items_sha256 and contaminated for each row."""
    names = {k for k, _ in _RESULTS}
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names or c == text_col]
    windows = benchmark.select(col(item_col).cast("string").alias("item"), col(item_text_col).alias("text")).mapInArrow(_benchmark_windows, "item string, n int, text binary, h1 bigint, h2 bigint")
    windows = cut(windows)
    if windows.count() > most_windows:
        return _by_join(docs, windows, kept, text_col)
    known = docs.sparkSession.sparkContext.broadcast(_Known([tuple(r) for r in windows.select("item", "n", "text").collect()]))
    text_at = kept.index(text_col) if text_col in kept else -1
    source = docs.select(*map(col, kept), *[col(text_col).alias("text")] * (text_at < 0))
    fields = [*source.schema.fields[: len(kept)], *(T.StructField(k, t) for k, t in _RESULTS)]
    return source.mapInArrow(_scan(known, kept, text_at), T.StructType(fields))


def _by_join(docs: DataFrame, windows: DataFrame, kept: list[str], text_col: str) -> DataFrame:
    """The same results by shuffles alone, for benchmarks of any size."""
    row, th = fresh(docs, "row", "th")
    # Rows with equal texts have equal results: everything is worked out by text.
    text = F.coalesce(col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(3), text).alias("t2"), text.alias("text")).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    lengths = sorted(r[0] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most

    def prints(batches, only: bool):
        for batch in K.slices(batches, "text"):
            words = K.Words(K.texts_of(batch.column("text")), K.NOT_ALNUM)
            at, hashes = fingerprints(words)
            rows = np.searchsorted(words.first, at, side="right") - 1
            cols = [] if only else [batch.column("t1").take(pa.array(rows)), batch.column("t2").take(pa.array(rows)), pa.array(at - words.first[rows], pa.int64())]
            yield pa.record_batch([*cols, pa.array(hashes.astype(np.int64))], ["print"] if only else ["t1", "t2", "at", "print"])

    def extended(batches):
        for batch in K.slices(batches, "text"):
            words = K.Words(K.texts_of(batch.column("text")), K.NOT_ALNUM)
            ats = [words.first[i] + np.array(x or [], dtype=np.int64) for i, x in enumerate(batch.column("ats").to_pylist())]
            fit = K.within(words.first, WINDOW)
            starts = np.unique((np.concatenate([*ats, np.zeros(0, dtype=np.int64)])[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            starts = starts[(starts >= 0) & (starts < len(fit))]
            for n, at in [(WINDOW, starts[fit[starts]]), *((n, np.flatnonzero(K.within(words.first, n))) for n in lengths)]:
                rows = np.searchsorted(words.first, at, side="right") - 1
                h = [K.grams(words.hash, n, seed)[at].astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64) for seed in (0, 1)]
                yield pa.record_batch([batch.column("t1").take(pa.array(rows)), batch.column("t2").take(pa.array(rows)), pa.array(at - words.first[rows], pa.int64()), pa.array(np.full(len(at), n), pa.int32()), pa.array(h[0]), pa.array(h[1])], ["t1", "t2", "at", "n", "h1", "h2"])

    def counted(batches):
        for batch in K.slices(batches, "text"):
            words = K.Words(K.texts_of(batch.column("text")), K.NOT_ALNUM)
            out = []
            for n_words, spans, items in zip(np.diff(words.first).tolist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hit = np.zeros(n_words, dtype=bool)
                for s in spans or []:
                    hit[s["at"] : s["at"] + s["n"]] = True
                out.append((n_words, int(hit.sum()), len(items or []), hashlib.sha256(",".join(sorted(items or [])).encode()).hexdigest(), bool(hit.any())))
            yield pa.record_batch([batch.column("t1"), batch.column("t2"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], ["t1", "t2", *(k for k, _ in _RESULTS)])

    known = windows.where(F.col("n") == WINDOW).select("text").mapInArrow(lambda b: prints(b, True), "print bigint").distinct()
    hits = texts.mapInArrow(lambda b: prints(b, False), "t1 bigint, t2 bigint, at bigint, print bigint").join(known, "print", "left_semi")
    around = hits.groupBy("t1", "t2").agg(F.collect_set("at").alias("ats"))
    tried = texts.join(around, ["t1", "t2"], "left" if lengths else "inner").mapInArrow(extended, "t1 bigint, t2 bigint, at bigint, n int, h1 bigint, h2 bigint")
    met = tried.join(windows.select("n", "h1", "h2", "item"), ["n", "h1", "h2"])
    per = met.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item").alias("items"))
    types = ", ".join(f"{k} {t.simpleString()}" for k, t in _RESULTS)
    results = texts.join(per, ["t1", "t2"], "left").mapInArrow(counted, f"t1 bigint, t2 bigint, {types}")
    keyed = docs.select(*map(col, kept), F.xxhash64(text).alias(row), F.xxhash64(F.lit(3), text).alias(th))
    return keyed.join(results, (F.col(row) == F.col("t1")) & (F.col(th) == F.col("t2"))).select(*(keyed[col_] for col_ in kept), *(results[k] for k, _ in _RESULTS))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that no window of the benchmark hits, all columns unchanged (but those with result names, which go)."""
    found = find_hits(docs, benchmark, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    return found.where("not contaminated").select(*(col(c) for c in docs.columns if c in found.columns and c not in dict(_RESULTS)))
