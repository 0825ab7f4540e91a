"""Byte-level BPE by Spark's higher-order functions: ranked merges folded over the bytes of distinct words.

Texts are split by the tokenizer's pattern in Spark, distinct words of all texts are counted, and `aggregate` folds each of
them once: the state holds the tokens of the word and the ranks of its adjacent pairs, and a step merges the leftmost
pair of lowest rank. The rank map is a literal: Spark scans a map's keys one after the other, so it is laid out as a
perfect hash table in two literal arrays. An id is its rank, so a pair's rank is also what it becomes.

Words go back to their texts in two ways that give the same ids. The most frequent words (HOT at most, of at most HOT_BYTES
bytes) are a literal table too. All others are met by a join on the word and come back as a dictionary for
each text, under a 64-bit hash of the text; texts that share a hash share a dictionary, which changes no result as words are looked up
in it by their own characters. Decoding looks up each id's piece and concatenates the pieces.

Defined results: a null or empty text has no tokens and decodes to no bytes; rows are handled one by one, so nulls in the id,
repeated rows and ties give one result row each; columns besides the id and the text are not read, whatever they
are called; an empty table gives an empty result. Texts are never cut. A word of n bytes takes up to n steps of n copied
values each, so one word of 20,000 bytes without a space costs as much as very many usual ones.
"""

from __future__ import annotations

import base64
import json
import struct
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.runtime import col, stored

#: Words in the literal table at most, and the length of the longest that may be in it.
HOT, HOT_BYTES = 100_000, 64
#: No rank: the greater of all ranks, which are ids below 65536.
_NONE = 1 << 16
_EMPTY = 1 << 50
_SEED = 42  # of Spark's xxhash64


def default_path() -> str:
    """byte_bpe_multi_50k.tiktoken where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _known(kind: str) -> frozenset[str]:
    """The characters of a Unicode class as the tokenizer library has it."""
    import tiktoken

    whole = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    found = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return frozenset(bytes(found.encode_ordinary(whole)).decode())


@lru_cache(maxsize=2)
def split_pattern(spark: SparkSession) -> str:
    """The tokenizer's split for Java's regular expressions.

    White space is Unicode's, and letters and numbers that the library knows and this Java doesn't are named one by one.
    """
    import public_tokenizers

    whole = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    inner = {}
    for kind in "LN":
        java = spark._jvm.java.util.regex.Pattern.compile(rf"\P{{{kind}}}+").matcher(whole).replaceAll("")
        more = sorted(map(ord, _known(kind) - set(java)))
        starts = [c for before, c in zip([-1, *more], more, strict=False) if c != before + 1]
        ends = [c for c, after in zip(more, [*more[1:], -1], strict=True) if after != c + 1]
        ranges = "".join(rf"\x{{{x:x}}}-\x{{{y:x}}}" for x, y in zip(starts, ends, strict=True))
        inner[kind] = rf"\p{{{kind}}}" + (rf"[\x{{{more[0]:x}}}-\x{{10ffff}}&&[{ranges}]]" if more else "")
    letters, numbers, others = rf" ?[{inner['L']}]+", rf" ?[{inner['N']}]+", rf" ?[^\s{inner['L']}{inner['N']}]+"
    first, *rest = public_tokenizers.PATTERN.split(r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|")
    if len(rest) != 1:
        raise ValueError("another pattern than the one that this split is made for")
    return f"(?U){first}|{letters}|{numbers}|{others}|{rest[0]}"


def _literal(values: list, kind: str) -> Column:
    """A literal array; Spark folds the parsing when it plans."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _place(key: Column, shifts: Column, seed: int, size: int, groups: int) -> Column:
    """Where the key is in a table, if it is in it."""

    def place(hashed: Column) -> Column:
        shift = F.get(shifts, hashed.bitwiseAND(F.lit(groups - 1)).cast("int"))
        return F.shiftrightunsigned(hashed, 20).bitwiseXOR(shift).bitwiseAND(F.lit(size - 1)).cast("int")

    return _let(F.xxhash64(F.lit(seed), key), place)


def _perfect(keys: list[bytes]) -> tuple[list[int], list[int], int, int, int]:
    """A place for each key, no two alike: places, shifts of the groups of keys, seed, and how many places and groups there are."""
    size = 1 << max(4, (2 * len(keys)).bit_length())
    groups = size // 8
    for seed in range(1000):
        with_seed = xxhash.xxh64(struct.pack("<i", seed), seed=_SEED).intdigest()
        h = np.array([xxhash.xxh64(k, seed=with_seed).intdigest() for k in keys], dtype=np.uint64)
        base, group = (h >> np.uint64(20)).astype(np.int64) & size - 1, (h & np.uint64(groups - 1)).astype(np.int64)
        if len(np.unique(group * size + base)) == len(keys):  # else two of a group could never be parted
            break
    else:
        raise ValueError("no seed parts all keys")
    order = np.argsort(group, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []
    used, places, shifts, draw = np.zeros(size, dtype=bool), np.zeros(len(keys), dtype=np.int64), np.zeros(groups, dtype=np.int64), np.random.default_rng(1)
    for part in sorted(parts, key=len, reverse=True):
        shift = 0
        while used[base[part] ^ shift].any():
            shift = int(draw.integers(size))
        used[base[part] ^ shift], places[part], shifts[group[part[0]]] = True, base[part] ^ shift, shift
    return places.tolist(), shifts.tolist(), seed, size, groups


@lru_cache(maxsize=2)
def _merges(path: str) -> tuple[list[int], list[int], int, int, int]:
    """The rank map of pairs of tokens as a perfect hash table: slots hold the pair, and its rank in their last 16 bits."""
    ranks = load_ranks(path)
    pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    places, shifts, *sizes = _perfect([struct.pack("<q", a << 16 | b) for a, b in pairs])
    slots = [_EMPTY] * sizes[1]
    for ((a, b), rank), at in zip(pairs.items(), places, strict=True):
        slots[at] = (a << 16 | b) << 16 | rank
    return slots, shifts, *sizes


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_word(word: Column, path: str) -> Column:
    """The ids (array of bigint) of one word, merged as one piece."""
    ranks = load_ranks(path)
    slots, shifts, *sizes = _merges(path)
    one, none = F.lit(1), F.array().cast("array<bigint>")

    def folded(maps: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            return _let(F.shiftleft(a, 16).bitwiseOR(b), lambda key: F.get(maps["slots"], _place(key, maps["shifts"], *sizes)).bitwiseXOR(F.shiftleft(key, 16)))

        def state(tokens: Column, found: Column) -> Column:
            return F.struct(tokens.alias("t"), found.alias("r"), F.coalesce(F.array_min(found), F.lit(_NONE).cast("bigint")).alias("least"))

        def start(tokens: Column) -> Column:
            return _let(F.zip_with(F.slice(tokens, one, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.size(tokens)), rank), lambda found: state(tokens, found))

        def merged(s: Column, at: Column) -> Column:
            t, r, new, n = s["t"], s["r"], s["least"], F.size(s["t"])
            before = F.when(at > 1, F.array(rank(F.get(t, at - 2), new))).otherwise(none)
            after = F.when(at < n - 1, F.array(rank(new, F.get(t, at + 1)))).otherwise(none)
            tokens = F.concat(F.slice(t, one, at - 1), F.array(new), F.slice(t, at + 2, n))
            found = F.concat(F.slice(r, one, F.greatest(at - 2, F.lit(0))), before, after, F.slice(r, at + 2, n))
            return _let(found, lambda x: state(tokens, x))

        latin = F.split(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), "")
        own = F.transform(latin, lambda c: F.get(maps["bytes"], F.ascii(c)))
        steps = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
        return F.aggregate(steps, _let(own, start), lambda s, _: F.when(s["least"] < _NONE, _let(F.array_position(s["r"], s["least"]).cast("int"), lambda at: merged(s, at))).otherwise(s), lambda s: s["t"])

    own_bytes = [ranks[bytes([b])] for b in range(256)]
    return _let(F.struct(_literal(slots, "bigint").alias("slots"), _literal(shifts, "bigint").alias("shifts"), _literal(own_bytes, "bigint").alias("bytes")), folded)


def word_ids(docs: DataFrame, *, text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """word, n (its occurrences in all texts) and ids (comma-joined decimals) of every distinct word."""
    spark, path = docs.sparkSession, ranks or default_path()
    words = docs.select(F.explode(_words(spark, col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    spread = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    return spread.select("word", "n", F.array_join(fold_word(F.col("word"), path).cast("array<string>"), ",").alias("ids"))


def _words(spark: SparkSession, text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(split_pattern(spark)), F.lit(0))


def _frequent(known: DataFrame) -> DataFrame:
    """The most frequent words: all with at least as many occurrences as keeps their number to HOT."""
    level = F.floor(8 * F.log2("n")).cast("int")
    short = known.where(F.octet_length("word") <= HOT_BYTES)
    left, least = HOT, None
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):  # 512 levels at most
        left -= row["count"]
        if left < 0:
            break
        least = row["level"]
    return short.where(level >= least) if least is not None else short.limit(0)


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id and ids, the comma-joined decimal ids of the text, for each row."""
    spark, path = docs.sparkSession, ranks or default_path()
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("key"))
    known = stored(word_ids(source, ranks=path))
    frequent = stored(_frequent(known).select("word", "ids"))
    table = frequent.collect()  # HOT rows of bounded length at most

    places, shifts, *sizes = _perfect([r.word.encode() for r in table])
    names, own = [""] * sizes[1], [""] * sizes[1]
    for r, at in zip(table, places, strict=True):
        names[at], own[at] = r.word, r.ids
    maps = F.struct(_literal(names, "string").alias("names"), _literal(own, "string").alias("ids"), _literal(shifts, "bigint").alias("shifts"))

    rare = source.select("key", F.explode(F.array_distinct(_words(spark, F.col("text")))).alias("word")).join(F.broadcast(frequent), "word", "left_anti").distinct()
    dictionary = rare.join(known.select("word", "ids"), "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))

    def whole(m: Column) -> Column:
        def usual(word: Column) -> Column:
            return _let(_place(word, m["shifts"], *sizes), lambda at: F.when(F.get(m["names"], at) == word, F.get(m["ids"], at)))

        def rest(word: Column) -> Column:
            return F.get(F.col("rare")["ids"], F.array_position(F.col("rare")["word"], word).cast("int") - 1)

        return F.array_join(F.transform(_words(spark, F.col("text")), lambda word: F.coalesce(usual(word), rest(word))), ",")

    return source.join(dictionary, "key", "left").select("doc_id", _let(maps, whole).alias("ids"))


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The bytes of comma-joined decimal ids: the pieces of all ids, concatenated."""
    pieces = {i: t.hex() for t, i in load_ranks(path or default_path()).items()}
    table = _literal([pieces.get(i, "") for i in range(max(pieces) + 1)], "string")
    whole = F.transform(F.split(ids, ",").cast("array<int>"), lambda i: F.get(table, i))
    return F.when(ids == "", F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(whole, "")))


def encode_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of comma-joined decimal ids) and decoded_sha256 (of the decoded bytes) for each row."""
    ids = F.col("ids")
    n = F.when(ids == "", F.lit(0)).otherwise(F.octet_length(ids) - F.octet_length(F.replace(ids, F.lit(","), F.lit(""))) + 1).cast("long")
    out = encoded(docs, id_col=id_col, text_col=text_col, ranks=ranks)
    return out.select("doc_id", n.alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decode_ids(ids, ranks), 256).alias("decoded_sha256"))
