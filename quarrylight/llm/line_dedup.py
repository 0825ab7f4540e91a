"""Line dedup, in DataFrame functions only.

Lines are exploded and normalised, their keys hashed (two 64-bit hashes and the length), distinct
documents counted per hash, and the lines of keys over the threshold dropped, except in
the document of smallest id that holds the key. What is dropped comes back to each document as
a bitmap over its lines, so that texts are shuffled once and reassembled by position.

A key that many documents share costs one partially aggregated row for each task that reads it. Shared keys are
written to the shared folder first; the join with them is an inner join that adaptive execution splits by skew.

Defined results: a null or empty text is one empty line; rows without an id count together as
one document after all others; rows with equal ids count as one document, each keeping
its own text; other columns are carried along unchanged, whatever they are called; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.runtime import col, cut, fresh

#: White space at the ends of lines that keys leave out (fixed values: space, \t to \r).
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their kept lines as text, and columns n_lines and n_dropped after all others.

    Existing columns called n_lines or n_dropped are replaced.
    """
    docs = docs.select(*(col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")))
    did, th, lines, words, dropped = fresh(docs, "did", "th", "lines", "words", "dropped")
    keyed = docs.withColumns({did: F.coalesce(col(id_col), F.lit(_LAST)), th: F.xxhash64(F.coalesce(col(text_col), F.lit("")))})

    text = F.coalesce(col(text_col), F.lit(""))
    exploded = keyed.select(F.col(did).alias("did"), F.col(th).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    bare = exploded.where(F.char_length("line") >= min_chars).select("did", "th", "pos", line_key(F.col("line")).alias("key"))
    hashed = bare.where(F.char_length("key") >= min_chars).select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.char_length("key"), "key").alias("h2"))

    if min_docs <= 2:
        counted = hashed.groupBy("h1", "h2").agg(F.min("did").alias("keeper"), F.max("did").alias("last"))
        shared = counted.where(F.col("last") != F.col("keeper")) if min_docs == 2 else counted
    else:
        counted = hashed.groupBy("h1", "h2", "did").agg(F.lit(1).alias("n")).groupBy("h1", "h2").agg(F.min("did").alias("keeper"), F.count(F.lit(1)).alias("n"))
        shared = counted.where(F.col("n") >= min_docs)
    shared = cut(shared.select("h1", "h2", "keeper"))  # a table of its own, so that the join's other side can be split by skew
    gone = hashed.join(shared, ["h1", "h2"]).where(F.col("did") != F.col("keeper"))
    bits = gone.groupBy("did", "th", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    dense = "aggregate(array_sort(collect_list(struct(word, bits))), cast(array() as array<bigint>), (a, x) -> concat(a, array_repeat(0L, x.word - size(a)), array(x.bits)))"
    marks = bits.groupBy(F.col("did").alias(did), F.col("th").alias(th)).agg(F.expr(dense).alias(words), F.sum(F.bit_count("bits")).cast("long").alias(dropped))

    out = keyed.join(marks, [did, th], "left").withColumn(lines, F.split(text, "\n", -1))
    kept = F.array_join(F.filter(F.col(lines), lambda line, i: F.coalesce(F.get(F.col(words), F.shiftright(i, 6)), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))) == 0), "\n")
    new_text = F.when(F.col(dropped).isNull(), col(text_col)).otherwise(kept)
    return out.select(
        *(new_text.alias(c) if c == text_col else col(c) for c in docs.columns),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
    )
