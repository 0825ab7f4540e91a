"""Alignment of two tokenizers by common token ends.

Both vocabularies cut a text before a run of spaces and line ends that follows something else, so tokens of the words
between such places (with the white space before them) are the same wherever they stand, and their last ends are common ones. Texts of
some HELD characters make one row, which holds their distinct words once, and each text as places of its words. The distinct
words of all rows are tokenised and aligned once each. Python only cuts and tokenises: a word comes back as ids and byte ends by
a byte-level BPE vocabulary (A, with a space before the text) and by a piece vocabulary (B, which adds that space itself). All
else is Spark's higher-order functions: array_intersect of a word's two arrays of ends gives the places where both tokens end;
these cut it into groups, and the two tokens that end at such a place are linked. In long words ends are looked up in blocks of BLOCK
common ends, whose bounds come from a binary search (aggregate over a sequence), so that the work grows with the word and not with
its square.

Counts of linked id pairs are taken over all texts: over the distinct words, each as often as it occurs. Pairs that make up at least
one in FREQUENT of all links (so there are at most FREQUENT of them) are broadcast; the rest, none of them hot, are joined. Words go
back to the rows that hold them by a join on the word, and a text's groups and sums are put together from those of its words.

Defined results: a text that is null or empty, or whose tokens don't spell a space and the text byte by byte on both sides
(the piece vocabulary may normalise), has no tokens: all counts are 0 and the groups are the empty string. Special
tokens' strings inside texts are plain text. Rows are handled one by one, so nulls in the id, repeated rows and ties give one
result row each; columns besides the id and the text are not read, whatever they are called; an empty table gives an
empty result. Texts are never cut: memory of a task grows with its longest text. With a piece vocabulary that normalises or has
pieces across such places, a whole text is one word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import bpe
from quarrylight.llm.runtime import col, dropped, stored, sweep

#: Common ends in a block, within which ends are looked up one after the other.
BLOCK = 64
#: Broadcast pairs make up at least one in so many of all links.
FREQUENT = 200_000
#: Characters of text whose words are held together in a row; a longer text makes a row by itself.
HELD = 16 << 20
#: Characters of words that are tokenised in one go.
GO = 1 << 16

#: Words, which start where a space or a line end follows something that is not white space.
_WORD = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_RUNS = ("  ", " \n", "\n ", "\n\n")
#: Marks that end a word after a letter or digit are words too.
_MARKS = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])([.,!?;:]+)(?=[ \n]|\Z)")


def default_paths() -> tuple[str, str]:
    """byte_bpe_50k.json and piece_bpe_32k.model where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The piece tokenizer, the bytes of each of its ids, and whether words of _WORD stay apart in it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    with open(path, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    plain, kind = spec.normalizer_spec, spec.trainer_spec
    apart = not plain.precompiled_charsmap and plain.add_dummy_prefix and not plain.remove_extra_whitespaces and plain.escape_whitespaces and not kind.treat_whitespace_as_suffix
    apart = apart and kind.model_type == kind.BPE and sum(map(model.is_byte, range(len(names)))) == 256 and all(x.type != x.USER_DEFINED for x in spec.pieces) and not any(re.search(r"[^▁]▁|[ \n]|[A-Za-z0-9À-ÖØ-öø-ÿ][.,!?;:]", x) for x in names)
    return model, [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)], apart


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def cut_words(text: str) -> list[str]:
    """The words of a text with a space before it; the space that most of them start with is left out (see `whole_word`)."""
    if text.replace("\n", "").isprintable() and text[0] not in " \n" and text[-1] != " " and not any(x in text for x in _RUNS):
        return _MARKS.sub(" \x01\\1", text).replace("\n", " \n").split(" ")
    return [w[1:] if w[0] == " " and w[1:2] not in ("", " ", "\n", "\x01") else w for w in _WORD.findall(" " + text)]


def whole_word(word: str) -> str:
    """The word with its white space."""
    return word[1:] if word[0] == "\x01" else word if word[0] in " \n" else " " + word


class _Tokens:
    """Tokens of words by both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, (self.model, self.of_b, self.apart), self.library = bpe.load(path_a), _pieces(path_b), _library(path_a)
        self.size_a, self.size_b = np.zeros(max(self.a.bytes_of) + 1, dtype=np.int64), np.array([len(x) for x in self.of_b], dtype=np.int64)
        for i, x in self.a.bytes_of.items():
            self.size_a[i] = len(x)

    def of(self, words: list[str]) -> list[tuple[np.ndarray, ...]]:
        """For both vocabularies: ids, their byte ends in the word, and how many each word has (none if they don't spell it)."""
        parts, at = [], 0
        while at < len(words):
            began, held = at, 0
            while at < len(words) and (at == began or self.apart and held + len(words[at]) <= GO and self._follows(words[at - 1][-1], words[at][0])):
                held += len(words[at])
                at += 1
            parts.append(self._go(words[began:at]))
        none = (np.zeros(0, dtype=np.int64),) * 3
        return [tuple(np.concatenate([none[k], *[x[side][k] for x in parts]]) for k in range(3)) for side in (0, 1)]

    @staticmethod
    def _follows(last: str, first: str) -> bool:
        """Whether tokens end between these characters of two words."""
        return not last.isspace() and first in " \n" or last.isascii() and last.isalnum() and first in ".,!?;:"

    def _go(self, words: list[str]) -> list[tuple[np.ndarray, ...]]:
        """Words that follow each other as if they were a text; before them stands one more, so that all stand within it."""
        ahead = "x" if self.apart else ""
        raw, text = [w.encode() for w in words], ahead + "".join(words)
        lasts, whole, out = np.cumsum([len(x) for x in raw]), b"".join(raw), []
        ids_a = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids_b = self.model.encode(text if ahead else text[1:])
        for ids, size, bytes_of, skip in ((ids_a, self.size_a, self.a.bytes_of, len(ahead)), (ids_b, self.size_b, self.of_b, 2 * len(ahead))):
            if b"".join(map(bytes_of.__getitem__, ids))[skip:] != whole:
                if len(words) > 1:  # one by one, to find those that aren't spelt
                    return [tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in zip(*[self._go([w]) for w in words], strict=True)]
                return [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(1, dtype=np.int64),)] * 2
            ids = np.array(ids, dtype=np.int64)
            ends = np.cumsum(size[ids]) - skip
            ids, ends = ids[ends > 0], ends[ends > 0]
            word = np.searchsorted(lasts, ends)
            out.append((ids, ends - np.concatenate([[0], lasts[:-1]])[word], np.bincount(word, minlength=len(words))))
        return out


def _list(values, firsts) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), values)


def _firsts(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def texts_by_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """A row for some texts: ids and words (places in known, from 0) of each; and their distinct words: known, and times (how often each occurs)."""
    _, path_b = vocabularies or default_paths()

    def run(batches):
        apart = _pieces(path_b)[2]

        def words(text: str) -> list[str]:
            if not text or "\u2581" in text:  # which is spelt as a space
                return []
            return cut_words(text) if apart else [text]

        def row(ids: list, texts: list[np.ndarray], index: dict[str, int]) -> pa.RecordBatch:
            flat, firsts = np.concatenate(texts), _firsts([len(x) for x in texts])
            columns = [pa.concat_arrays(ids), _list(pa.array(flat, pa.int32()), firsts), pa.array(list(index), pa.string()), pa.array(np.bincount(flat, minlength=len(index)), pa.int64())]
            return pa.record_batch([_list(x, [0, len(x)]) for x in columns], ["ids", "words", "known", "times"])

        def empty() -> defaultdict:
            index = defaultdict()
            index.default_factory = index.__len__
            return index

        ids, texts, index, held = [], [], empty(), 0
        for batch in batches:
            began = 0
            for at, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if texts and held + len(text) > HELD:
                    ids.append(batch.column(0).slice(began, at - began))
                    yield row(ids, texts, index)
                    ids, texts, index, held, began = [], [], empty(), 0, at
                held += len(text)
                texts.append(np.array(list(map(index.__getitem__, words(text))), dtype=np.int32))
            ids.append(batch.column(0).slice(began))
        if texts:
            yield row(ids, texts, index)

    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"ids array<{kind}>, words array<array<int>>, known array<string>, times array<bigint>")


def tokens(words: DataFrame, *, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Ids and byte ends of the tokens of each word by both vocabularies, a, a_ends, b, b_ends (arrays of int), beside word and times."""
    path_a, path_b = vocabularies or default_paths()

    def run(batches):
        own = _Tokens(path_a, path_b)
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                began, held = at, 0
                while at < len(texts) and (at == began or held + len(texts[at]) <= 16 * GO):
                    held += len(texts[at])
                    at += 1
                sides = own.of([whole_word(w) if own.apart else " " + w for w in texts[began:at]])
                lists = [_list(pa.array(x, pa.int32()), _firsts(n)) for ids, ends, n in sides for x in (ids, ends)]
                yield pa.record_batch([*[batch.column(k).slice(began, at - began) for k in (0, 1)], *lists], ["word", "times", "a", "a_ends", "b", "b_ends"])

    return words.select("word", "times").mapInArrow(run, "word string, times bigint, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>")


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _up_to(ends: Column, end: Column) -> Column:
    """How many of the rising ends are at most `end`: a binary search over 31 bits of the answer at most."""
    bits = F.sequence(F.ceil(F.log2(F.size(ends) + 1)).cast("int"), F.lit(0), F.lit(-1))
    return F.aggregate(bits, F.lit(0), lambda n, bit: F.when(F.get(ends, n + F.call_function("shiftleft", F.lit(1), bit) - 1) <= end, n + F.call_function("shiftleft", F.lit(1), bit)).otherwise(n))


def _blocks(word: Column, common: Column) -> Column:
    """The common ends in blocks, each with the tokens of both sides up to its last end."""
    first = F.sequence(F.lit(0), F.size(common) - 1, F.lit(BLOCK))

    def block(at: Column) -> Column:
        low = F.coalesce(F.get(common, at - 1), F.lit(0))
        high = F.get(common, F.least(at + BLOCK, F.size(common)) - 1)

        def part(side: str) -> Column:
            ends = word[f"{side}_ends"]
            return _let(F.struct(_up_to(ends, low).alias("low"), _up_to(ends, high).alias("high")), lambda x: F.struct(F.slice(word[side], x["low"] + 1, x["high"] - x["low"]).alias("ids"), F.slice(ends, x["low"] + 1, x["high"] - x["low"]).alias("ends")))

        return F.struct(F.slice(common, at + 1, F.lit(BLOCK)).alias("ends"), part("a").alias("a"), part("b").alias("b"))

    whole = F.struct(common.alias("ends"), *[F.struct(word[side].alias("ids"), word[f"{side}_ends"].alias("ends")).alias(side) for side in ("a", "b")])
    return F.when(F.size(common) <= BLOCK, F.array(whole)).otherwise(F.transform(first, block))


def _placed(blocks: Column) -> Column:
    """For each block: ids of both sides, and the places of its common ends among them (from 1)."""
    place = lambda x, side: F.transform(x["ends"], lambda end: F.array_position(x[side]["ends"], end).cast("int")).alias(f"at_{side}")
    return F.transform(blocks, lambda x: F.struct(x["a"]["ids"].alias("a"), x["b"]["ids"].alias("b"), place(x, "a"), place(x, "b")))


def _links(placed: Column) -> Column:
    """The linked id pairs, one for each common end, in order."""
    return F.flatten(F.transform(placed, lambda x: F.zip_with(x["at_a"], x["at_b"], lambda i, j: F.struct(F.get(x["a"], i - 1).alias("a"), F.get(x["b"], j - 1).alias("b")))))


def _groups(placed: Column) -> Column:
    """The groups as text: `a1,a2|b1;a3|b2,b3`."""

    def written(x: Column, a: Column, b: Column) -> Column:
        def ids(names: Column, at: Column, k: Column) -> Column:
            before = F.coalesce(F.get(at, k - 1), F.lit(0))
            return F.array_join(F.slice(names, before + 1, F.get(at, k) - before), ",")

        return F.array_join(F.transform(x["at_a"], lambda _, k: F.concat(ids(a, x["at_a"], k), F.lit("|"), ids(b, x["at_b"], k))), ";")

    return F.array_join(F.transform(placed, lambda x: _let(F.struct(x["a"].cast("array<string>").alias("a"), x["b"].cast("array<string>").alias("b")), lambda s: written(x, s["a"], s["b"]))), ";")


def _aligned(word: Column) -> Column:
    """Groups (as text) and links of one word. Where either side has one token, both end together at the last only."""
    ids = lambda side: F.array_join(word[side].cast("array<string>"), ",")
    last = lambda side: F.get(word[side], F.size(word[side]) - 1).alias(side)
    one = F.struct(F.concat(ids("a"), F.lit("|"), ids("b")).alias("groups"), F.array(F.struct(last("a"), last("b"))).alias("links"))
    more = _let(F.array_intersect(word["a_ends"], word["b_ends"]), lambda common: _let(_placed(_blocks(word, common)), lambda p: F.struct(_groups(p).alias("groups"), _links(p).alias("links"))))
    return F.when((F.size(word["a"]) == 1) | (F.size(word["b"]) == 1), one).otherwise(more)


def aligned_words(rows: DataFrame, *, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """word, times, n_a, n_b, groups and links of every distinct word of the rows of texts_by_words; without tokens: 0, no groups and no links."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.select(F.inline(F.arrays_zip(F.col("known").alias("word"), F.col("times").alias("times")))).repartition(n, "word")
    known = tokens(each.groupBy("word").agg(F.sum("times").alias("times")), vocabularies=vocabularies)
    word = F.struct("a", "a_ends", "b", "b_ends")
    out = known.select("word", "times", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.when(F.size("a") > 0, _let(word, _aligned)).alias("x"))
    return out.select("word", "times", "n_a", "n_b", F.coalesce("x.groups", F.lit("")).alias("groups"), F.coalesce("x.links", F.array().cast("array<struct<a: int, b: int>>")).alias("links"))


def _back(rows: DataFrame, words: DataFrame, own: Column) -> DataFrame:
    """The rows of texts_by_words, with `own` (which may name at, a word's place, and what `words` has of it) of each of the row's known words, sorted."""
    each = rows.select("rid", F.posexplode("known").alias("at", "word")).join(words.hint("shuffle_hash"), "word")
    told = each.groupBy("rid").agg(F.sort_array(F.collect_list(own)).alias("own"))  # words of HELD characters
    return rows.select("rid", "ids", "words").join(told, "rid", "left")


def _sum(words: Column, name: str) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, i: s + F.get("own", i)[name])


def _packed(*told: Column) -> Column:
    """Numbers and groups in half as many bytes: their thirteen characters, and D between them, as half bytes."""
    half = F.translate(F.concat_ws("D", *told), ",|;", "ABC")
    return F.unhex(F.when(F.length(half) % 2 == 1, F.concat(half, F.lit("F"))).otherwise(half))


def _unpacked(packed: Column) -> Column:
    """The numbers and groups of a word, from bytes that have its place before them. A text's n_a and n_b (below 2 ** 31) are added as one number."""
    told = F.split(F.translate(F.substring(F.hex(packed), 9, (1 << 31) - 1), "ABCF", ",|;"), "D")
    number = lambda x, k: F.get(x, k).cast("long")
    return _let(told, lambda x: F.struct((F.shiftleft(number(x, 0), 32) + number(x, 1)).alias("n_ab"), number(x, 2).alias("n"), number(x, 3).alias("best"), F.get(x, 4).alias("groups")))


def _groups_of(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda i: F.get("own", i)["groups"]), ";")


def _numbered(rows: DataFrame) -> DataFrame:
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), *rows.columns), compression="zstd")


def alignments(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, groups (as text) and links (array of (a, b), one for each common end) for each row."""
    rows = _numbered(texts_by_words(docs, id_col=id_col, text_col=text_col, vocabularies=vocabularies))
    links = lambda words: F.flatten(F.transform(words, lambda i: F.get("own", i)["links"]))
    of = lambda words, k: F.struct(F.get("ids", k).alias("doc_id"), _sum(words, "n_a").alias("n_a"), _sum(words, "n_b").alias("n_b"), _groups_of(words).alias("groups"), links(words).alias("links"))
    return _back(rows, aligned_words(rows, vocabularies=vocabularies), F.struct("at", "n_a", "n_b", "groups", "links")).select(F.inline(F.transform("words", of)))


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n (how many links hold the pair linked) and best (n is the highest of its b) of every linked pair; links: a, b, times."""
    counts = links.groupBy("a", "b").agg(F.sum("times").alias("n"))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row for each id of the vocabulary at most
    return counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row."""
    rows = _numbered(texts_by_words(docs, id_col=id_col, text_col=text_col, vocabularies=vocabularies))
    words = stored(aligned_words(rows, vocabularies=vocabularies), compression="zstd")
    sweep(docs.sparkSession)

    each = words.select("word", "times", F.explode("links").alias("x")).select("word", "times", "x.a", "x.b")
    pairs = stored(pair_counts(each))
    sweep(docs.sparkSession)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    usual = F.col("n") * FREQUENT >= total
    near = each.drop("times").join(F.broadcast(pairs.where(usual)), ["a", "b"], "left")  # FREQUENT rows at most
    rest = near.where(F.col("n").isNull()).select("word", "a", "b").join(pairs.where(~usual), ["a", "b"])
    sums = lambda x: x.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("best").cast("long")).alias("best"))
    both = sums(near.where(F.col("n").isNotNull())).unionByName(sums(rest)).groupBy("word").agg(F.sum("n").alias("n"), F.sum("best").alias("best"))
    zero = F.lit(0).cast("long")
    told = _packed(F.col("n_a"), F.col("n_b"), F.coalesce("n", zero), F.coalesce("best", zero), F.col("groups"))
    own = stored(words.join(both, "word", "left").select("word", told.alias("told")), compression="zstd")
    dropped(words)
    sweep(docs.sparkSession)

    def text(words: Column, k: Column, groups: Column) -> Column:
        n = F.when(groups == "", F.lit(0)).otherwise(F.octet_length(groups) - F.octet_length(F.replace(groups, F.lit(";"), F.lit(""))) + 1).cast("long")
        digest = F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))
        return F.struct(F.get("ids", k).alias("doc_id"), _sum(words, "n_ab").alias("n_ab"), n.alias("n_links"), _sum(words, "best").alias("n_best"), _sum(words, "n").alias("count_sum"), digest.alias("groups_sha256"))

    n_a, n_b = F.shiftright("n_ab", 32).alias("n_a"), F.col("n_ab").bitwiseAND(F.lit((1 << 32) - 1)).alias("n_b")
    place = F.unhex(F.lpad(F.hex("at"), 8, "0"))  # four bytes in the order of the places
    out = _back(rows, own, F.concat(place, "told")).withColumn("own", F.transform("own", _unpacked))
    out = out.select(F.inline(F.transform("words", lambda words, k: _let(_groups_of(words), lambda groups: text(words, k, groups)))))
    return out.select("doc_id", n_a, n_b, F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
