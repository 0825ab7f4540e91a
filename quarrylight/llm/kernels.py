"""Vectorised text kernels over Arrow string buffers.

All of them work on UTF-8 bytes. The word classes in use are made of ASCII
characters and "everything else", so cutting bytes and cutting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside words of digits, ASCII letters and non-ASCII characters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

#: Lower-cases A-Z and no other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        for k, base in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(n + 1, base, dtype=U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


class Texts:
    """A run of texts as one byte buffer: text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """An Arrow string or binary column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0 or ends is None:
        return Texts(np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64))
    offsets = np.frombuffer(ends, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most_bytes` of text; a longer text goes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.diff(texts_of(batch.column(text)).offsets))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a run of texts: 64-bit hashes, byte ranges, and where each text's words begin.

    Words of text i are those from first[i] to first[i + 1].
    """

    def __init__(self, texts: Texts, separators: np.ndarray = SPACE):
        data, offsets = LOWER[texts.data], texts.offsets
        word = ~separators[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
        before[starts], after[ends - 1] = False, False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.lower = data
        self.hash = mix(_ranges(data, self.start, self.end) + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.start)


def _ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of data[start:end] for each pair, from one prefix sum."""
    total, down = _sums(data)
    return (total[end] - total[start]) * down[start]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of k consecutive items: one for each start, len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, U64(k * 0x2545F4914F6CDD1D + seed * 0x9E6C63D0876A9A47 & (1 << 64) - 1))
    for i in range(k):
        out *= U64(0xF1357AEA2E62A9C5)
        out += hashes[i : i + n]
    return mix(out)


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive bytes: one for each start."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total, down = _sums(data)
    out = total[k:] - total[:-k]
    out *= down[:n]
    return mix(out)


def winnow_bytes(hashes: np.ndarray, k: int, w: int, offsets: np.ndarray) -> np.ndarray:
    """Like winnow for hashes of k bytes, where texts begin at offsets; compares the upper half of hashes, which is faster."""
    if len(hashes) < w:
        return np.zeros(0, dtype=np.int64)
    a = (hashes >> U64(32)).astype(np.uint32)
    low = np.zeros(len(a) + 2 * (w - 1), dtype=np.uint32)
    low[w - 1 : len(a)] = sliding(a, w)
    for end in offsets[1:-1].tolist():  # windows that begin before the end of a text and reach beyond it
        low[max(w - 1, end - (w + k - 2) + w - 1) : end + w - 1] = 0
    return np.flatnonzero((sliding(low[: len(a) + w - 1], w, np.maximum) == a) & (a != 0))


def sliding(a: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each window of w items, by doubling: log2(w) passes."""
    span = 1
    while span * 2 <= w:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def winnow(a: np.ndarray, w: int, owner: np.ndarray, k: int = 1) -> np.ndarray:
    """Positions that hold the minimum of some window of w values, each of k items, all of one owner; ties all count."""
    if len(a) < w:
        return np.zeros(0, dtype=np.int64)
    low = sliding(a, w)
    low = np.where(owner[: len(low)] == owner[w + k - 2 :], low, a.dtype.type(0))
    padded = np.zeros(len(a) + w - 1, dtype=a.dtype)
    padded[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero((sliding(padded, w, np.maximum) == a) & (a != 0))


def owners(first: np.ndarray) -> np.ndarray:
    """For each item the index of its text, given where each text's items begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Which starts of k consecutive items stay inside one text."""
    owner = owners(first)
    n = len(owner) - k + 1
    return owner[:n] == owner[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)
