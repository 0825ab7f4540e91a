"""Full-text search with BM25: tokens, a small query language, ranking, and the fallback to substrings.

Words are runs of letters and digits, lower-cased, without accents; a word in a query with underscores is a phrase.
Space means AND; OR, NOT, "phrase", prefix* and column:word are known. Any other query, such as a.b or f(, falls
back to a substring search on the content, without a rank.

Ranks are those of BM25 with k1 = 1.2 and b = 0.75 over all columns together, negated, so that less is better.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class QuerySyntaxError(ValueError):
    """Not in the query language; callers fall back."""


def _plain_letters() -> tuple[str, str]:
    """Accented letters and the ones without accents that stand for them."""
    accented, plain = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isalpha():
            accented.append(chr(cp))
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _plain_letters()
_MARKS = r"\p{Mn}+"


def tokens(body: Column) -> Column:
    """The words of a text, in order."""
    plain = F.lower(F.regexp_replace(F.translate(F.coalesce(body, F.lit("")), _ACCENTED, _PLAIN), _MARKS, ""))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def fold(word: str) -> list[str]:
    """The words of a string, as `tokens` has them."""
    plain = "".join(c for c in word.translate(str.maketrans(_ACCENTED, _PLAIN)) if unicodedata.category(c) != "Mn").lower()
    return [w for w in re.split(r"[\W_]+", plain) if w]


@dataclass(frozen=True)
class Phrase:
    """Words that follow each other; the last may be a prefix; column None means any."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Node:
    """and, or, not over parts; or a phrase."""

    kind: str
    parts: tuple = ()
    phrase: Phrase | None = None

    def phrases(self) -> list[Phrase]:
        if self.phrase is not None:
            return [self.phrase]
        seen = [p for part in self.parts for p in part.phrases()]
        return list(dict.fromkeys(seen))


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\x80-\U0010ffff]+)|([:*()]))', re.A)


def parse_query(query: str, columns: tuple[str, ...]) -> Node:
    """A query as a tree. NOT binds more than AND, AND (also by space) more than OR."""
    lexed: list[tuple[str, str]] = []
    at = 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise QuerySyntaxError(f"at {query[at:].strip()[:10]!r}")
        lexed.append(("string", m[1].replace('""', '"')) if m[1] is not None else ("word", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    pos = 0

    def peek() -> tuple[str, str]:
        return lexed[pos] if pos < len(lexed) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal pos
        pos += 1
        return lexed[pos - 1] if pos <= len(lexed) else ("end", "")

    def expect(value: str) -> None:
        if take() != ("sign", value):
            raise QuerySyntaxError(f"expected {value}")

    def either() -> Node:
        parts = [both()]
        while peek() == ("word", "OR"):
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        parts = [but()]
        while peek()[0] in ("string", "word") and peek()[1] not in ("OR", "NOT") or peek() == ("sign", "("):
            if peek() == ("word", "AND"):
                take()
            parts.append(but())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def but() -> Node:
        left = one()
        while peek() == ("word", "NOT"):
            take()
            left = Node("not", (left, one()))
        return left

    def one() -> Node:
        kind, value = take()
        if (kind, value) == ("sign", "("):
            inner = either()
            expect(")")
            return inner
        if kind == "word" and value in ("AND", "OR", "NOT") or kind not in ("word", "string"):
            raise QuerySyntaxError(f"unexpected {value!r}")
        column = None
        if kind == "word" and peek() == ("sign", ":"):
            take()
            if value not in columns:
                raise QuerySyntaxError(f"no such column: {value}")
            column, (kind, value) = value, take()
            if kind not in ("word", "string"):
                raise QuerySyntaxError("expected a word after :")
        prefix = peek() == ("sign", "*")
        if prefix:
            take()
        return Node("phrase", phrase=Phrase(tuple(fold(value)), prefix, column))

    tree = either()
    if pos != len(lexed):
        raise QuerySyntaxError(f"unexpected {peek()[1]!r}")
    return tree


def indexed(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows with one array of words for each column, and doc_len over all of them.

    The arrays come out of a generator, which keeps the optimizer from splitting the text anew for each use of a word.
    """
    out = docs.select("*", F.inline(F.array(F.struct(*(tokens(F.col(c)).alias(f"words_{c}") for c in columns)))))
    return out.withColumn("doc_len", sum((F.size(f"words_{c}") for c in columns), F.lit(0)))


def frequency(phrase: Phrase, columns: tuple[str, ...]) -> Column:
    """How often a phrase occurs in a row of `indexed`."""
    found = [_occurrences(phrase, f"words_{c}") for c in columns if phrase.words and phrase.column in (None, c)]
    return sum(found[1:], found[0]) if found else F.lit(0)


def _occurrences(phrase: Phrase, column: str) -> Column:
    words, n = F.col(column), len(phrase.words)

    def ends(word: Column) -> Column:
        return word.startswith(phrase.words[-1]) if phrase.prefix else word == phrase.words[-1]

    if n == 1:
        return F.size(F.filter(words, ends))
    ahead = F.array(*map(F.lit, phrase.words[:-1]))

    def begins(i: Column) -> Column:
        return (F.slice(words, i, n - 1) == ahead) & ends(F.element_at(words, i + (n - 1)))

    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, begins))


def matches(node: Node, tf: dict[Phrase, Column]) -> Column:
    """Whether a row matches, by how often each phrase occurs in it."""
    if node.phrase is not None:
        return tf[node.phrase] > 0
    parts = [matches(p, tf) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.kind == "and" else out | p if node.kind == "or" else out & ~p
    return out


def scored(node: Node) -> list[Phrase]:
    """The phrases that count for the rank: all but those after NOT."""
    if node.phrase is not None:
        return [node.phrase]
    parts = node.parts[:1] if node.kind == "not" else node.parts
    return [p for part in parts for p in scored(part)]


def weight(all_docs: Column, holders: Column, tf: Column, doc_len: Column, mean_len: Column) -> Column:
    """What a phrase adds to the rank of a row in which it occurs tf times."""
    idf = F.greatest(F.log((all_docs - holders + 0.5) / (holders + 0.5)), F.lit(LEAST_IDF))
    t = tf.cast("double")
    return idf * t * (K1 + 1) / (t + K1 * (1 - B + B * doc_len / mean_len))


def match(docs: DataFrame, columns: tuple[str, ...], query: str) -> DataFrame:
    """The rows that match, with rank (less is better); raises QuerySyntaxError for other languages.

    Numbers of rows with each phrase and the mean length come from one aggregation over all rows.
    """
    tree = parse_query(query, columns)
    phrases = tree.phrases()
    if not any(p.words for p in phrases):
        return docs.where(F.lit(False)).withColumn("rank", F.lit(None).cast("double"))
    frame = indexed(docs, columns).withColumns({f"tf_{i}": frequency(p, columns) for i, p in enumerate(phrases)})
    tf = {p: F.col(f"tf_{i}") for i, p in enumerate(phrases)}
    totals = frame.agg(F.count(F.lit(1)).alias("all_docs"), F.avg("doc_len").alias("mean_len"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(phrases))))
    found = frame.where(matches(tree, tf)).crossJoin(F.broadcast(totals))
    rank = F.lit(0.0)
    for p in scored(tree):
        i = phrases.index(p)
        n = F.col(f"df_{i}")
        rank = rank - weight(F.col("all_docs"), n, F.col(f"tf_{i}"), F.col("doc_len"), F.col("mean_len"))
    return found.withColumn("rank", rank).select(*docs.columns, "rank")


def like_fallback(docs: DataFrame, column: str, query: str) -> DataFrame:
    """The rows whose column contains the query as it stands; their rank is null."""
    return docs.where(text.contains(F.col(column), query)).withColumn("rank", F.lit(None).cast("double"))


def search(docs: DataFrame, columns: tuple[str, ...], query: str, limit: int, *, key: str = "id", fallback: str | None = "content") -> DataFrame:
    """The best rows: by rank, then key. Without a fallback column, queries in other languages find nothing."""
    try:
        found = match(docs, columns, query)
    except QuerySyntaxError:
        found = like_fallback(docs, fallback, query) if fallback else docs.where(F.lit(False)).withColumn("rank", F.lit(None).cast("double"))
    return found.orderBy("rank", key).limit(limit)


def postings(docs: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """The inverted index: term, key, column, tf and positions, for stores that keep one."""
    parts = [docs.select(F.col(key), F.lit(c).alias("column"), F.posexplode(tokens(F.col(c))).alias("at", "term")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term", key, "column").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def rank_to_score(rank: Column) -> Column:
    """1 / (1 + |rank|) between 0 and 1; 0 without a rank."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + F.abs(rank)))), F.lit(0.0))
