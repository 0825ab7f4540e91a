"""A stored full-text index: positional posting lists that searches read instead of texts.

Tables of an index, all Parquet below one folder:

- documents: number (dense, in order of the key), key, doc_len and the words of each column
- postings: a row, or a few, for a term, a column and a block of BLOCK numbers: the documents as offsets from the block's first number,
  with doc_len and the positions in each. Tasks make them of runs of consecutive numbers, and they are shuffled once. A term that all documents hold is many rows, so no row grows with the corpus.
  Rows lie in folders by hash of the term and are sorted in them, so that a search reads its terms' buckets and row groups.
- terms: the dictionary, sorted by term: documents and occurrences in each column, and the bucket; prefixes are ranges of it
- stats: number of documents and sum of their lengths

Ranks are those of fulltext.match on the same rows. Phrases are found by joining positions: the n-th word's positions less n
meet at the phrase's start.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import fulltext

#: Numbers of documents that a posting row may hold, blocks of a bucket that are sorted by one task, words that a task turns into
#: postings at once, and posting rows in an Arrow batch.
BLOCK, SLOT, CHUNK, ROWS = 8192, 16, 1 << 22, 1 << 15
_POSTINGS = "term string, column int, block bigint, offsets array<int>, doc_lens array<int>, cuts array<int>, at array<int>"


@dataclass(frozen=True)
class Index:
    """An index in a folder (any path that Spark can write)."""

    spark: SparkSession
    folder: str
    columns: tuple[str, ...]
    key: str = "id"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def build(docs: DataFrame, columns: tuple[str, ...], folder: str, *, key: str = "id", buckets: int | None = None) -> Index:
    """Writes the index of the rows; `folder` must not hold one. Keys that are null or repeated are documents of their own."""
    spark = docs.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = Index(spark, folder, tuple(columns), key)

    # A row's number is its range's first number plus its place in the sorted range; both are written down before they are used. Texts
    # are moved whole and cut into words where they land: arrays of words are several times as large.
    named = docs.select(F.col(key).alias("key"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    words = fulltext.indexed(named.repartitionByRange("key").sortWithinPartitions("key"), tuple(f"c{i}" for i in range(len(columns))))
    ranged = words.drop(*(f"c{i}" for i in range(len(columns))))
    ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(f"{folder}/work")
    ranged = out.table("work")
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row for each task of the range
    firsts, first = {}, 0
    for part, n in sizes:
        firsts[part], first = first, first + n
    starts = spark.createDataFrame(sorted(firsts.items()), "part int, first long")
    numbered = ranged.join(F.broadcast(starts), "part").withColumn("number", F.col("first") + F.col("place"))

    lengths = [F.size(f"words_c{i}").alias(f"words_{i}") for i in range(len(columns))]
    numbered.select("number", "key", "doc_len", *lengths).write.parquet(f"{folder}/documents")
    rows = numbered.select("number", "doc_len", *(f"words_c{i}" for i in range(len(columns)))).mapInArrow(_lists(BLOCK), _POSTINGS)
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets))
    # The one shuffle of postings: a bucket goes to one task for each SLOT blocks, so that a term of all documents goes to many.
    # Flat arrays move, a few bytes for an entry; its positions are at[cuts[i]:cuts[i + 1]].
    dealt = rows.repartition("bucket", F.floor(F.col("block") / SLOT)).sortWithinPartitions("bucket", "term", "column", "block")
    entry = lambda o, i: F.struct(o.alias("offset"), F.get("doc_lens", i).alias("doc_len"), F.slice("at", F.get("cuts", i) + 1, F.get("cuts", i + 1) - F.get("cuts", i)).alias("at"))
    rows = dealt.select("term", "column", "block", F.transform("offsets", entry).alias("entries"), "bucket")
    rows.write.partitionBy("bucket").parquet(f"{folder}/postings")

    if not first:  # no rows, no files with a schema
        rows.limit(0).write.mode("overwrite").parquet(f"{folder}/postings")
    counted = out.table("postings").groupBy("term", "column", "bucket").agg(F.sum(F.size("entries").cast("long")).alias("documents"), F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + F.size(e["at"]))).alias("occurrences"))
    counted.repartitionByRange("term", "column").sortWithinPartitions("term", "column").write.parquet(f"{folder}/terms")
    totals = out.table("documents").agg(F.count(F.lit(1)).alias("all_docs"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0)).alias("all_words"), F.lit(buckets).alias("buckets"))
    totals.coalesce(1).write.parquet(f"{folder}/stats")
    return out


def _lists(size: int):
    """Postings of runs of documents with consecutive numbers, of CHUNK words or little more each, in blocks of `size`."""

    def run(batches):
        held, n, after = [], 0, None
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)] if len(number) else []
            for a, b in pairwise(cuts):
                if held and (n >= CHUNK or number[a] != after):
                    yield from _rows(held, size)
                    held, n = [], 0
                held.append(batch.slice(a, b - a))
                n += sum(len(c.flatten()) for c in held[-1].columns[2:])
                after = number[b - 1] + 1
        if held:
            yield from _rows(held, size)

    return run


def _rows(held: list[pa.RecordBatch], size: int):
    """The postings of some documents, those of a term in one block as one row."""
    whole = pa.Table.from_batches(held)
    number, doc_len = (whole.column(k).to_numpy() for k in (0, 1))
    block = number // size
    for column in range(whole.num_columns - 2):
        lists = whole.column(column + 2).combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        words, sizes = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy()
        if not len(words):
            continue
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # documents and places stay in order
        doc = np.repeat(np.arange(len(sizes)), sizes)[order]
        at = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        code = code[order]
        entry = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
        code, doc = code[entry], doc[entry]
        row = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[doc[1:]] != block[doc[:-1]])]))
        starts = np.append(row, len(entry))
        cuts = np.insert(np.append(entry, len(at)), starts[1:-1], entry[row[1:]])  # each row's own, its end included
        lists = [_parted(number[doc] % size, starts), _parted(doc_len[doc], starts), _parted(cuts - np.repeat(entry[row], np.diff(starts) + 1), starts + np.arange(len(starts))), _parted(at, np.append(entry[row], len(at)))]
        made = pa.record_batch([words.dictionary.take(pa.array(code[row])), pa.array(np.full(len(row), column), pa.int32()), pa.array(block[doc[row]], pa.int64()), *lists], ["term", "column", "block", "offsets", "doc_lens", "cuts", "at"])
        yield from (made.slice(k, ROWS) for k in range(0, made.num_rows, ROWS))


def _parted(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _bucket(term: Column, buckets: int | Column) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets) if isinstance(buckets, int) else buckets)


def _of_word(index: Index, buckets: int, word: str, prefix: bool, columns: list[int]) -> DataFrame:
    """Entries (column, block and e) of a word, or of all words that begin with it."""
    rows = index.table("postings").where(F.col("column").isin(columns))
    if not prefix:
        rows = rows.where((F.col("term") == word) & (F.col("bucket") == _bucket(F.lit(word), buckets)))
    else:
        begins = F.col("term").startswith(word)
        found = [r["bucket"] for r in index.table("terms").where(begins).select("bucket").distinct().collect()]  # `buckets` rows at most
        rows = rows.where(begins & F.col("bucket").isin(found)) if found else rows.where(F.lit(False))
    return rows.select("column", "block", F.explode("entries").alias("e")).select("column", (F.col("block") * BLOCK + F.col("e.offset")).alias("number"), "e.doc_len", "e.at")


def _counts(index: Index, buckets: int, phrase: fulltext.Phrase) -> DataFrame:
    """number, doc_len and tf of the documents with a phrase; a document may have several rows."""
    columns = [i for i, c in enumerate(index.columns) if phrase.column in (None, c)]
    n = len(phrase.words)
    if n == 1:
        return _of_word(index, buckets, phrase.words[0], phrase.prefix, columns).select("number", "doc_len", F.size("at").alias("tf"))
    parts = [_of_word(index, buckets, w, phrase.prefix and k == n - 1, columns).select("number", "doc_len", "column", F.lit(k).alias("k"), F.transform("at", lambda x: x - k).alias("starts")) for k, w in enumerate(phrase.words)]
    met = parts[0]
    for df in parts[1:]:
        met = met.unionByName(df)
    # Positions move as arrays, a row for a word and a document.
    each = met.groupBy("number", "doc_len", "column").agg(*(F.flatten(F.collect_list(F.when(F.col("k") == k, F.col("starts")))).alias(f"s{k}") for k in range(n)))
    starts = F.col("s0")
    for k in range(1, n):
        starts = F.array_intersect(starts, f"s{k}")
    return each.select("number", "doc_len", F.size(starts).alias("tf")).where("tf > 0")


def match(index: Index, query: str) -> DataFrame:
    """number and rank (less is better) of the matching documents; raises QuerySyntaxError for other languages."""
    tree = fulltext.parse_query(query, index.columns)
    phrases = [p for p in tree.phrases() if p.words]
    stats = index.table("stats").first()
    if not phrases:
        return index.spark.createDataFrame([], "number long, rank double")
    parts = [_counts(index, stats["buckets"], p).withColumn("phrase", F.lit(i)) for i, p in enumerate(phrases)]
    met = parts[0]
    for df in parts[1:]:
        met = met.unionByName(df)
    tf = {p: F.col(f"tf_{i}") for i, p in enumerate(phrases)}
    found = met.groupBy("number").agg(F.max("doc_len").alias("doc_len"), *(F.coalesce(F.sum(F.when(F.col("phrase") == i, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i in range(len(phrases))))
    holders = found.agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(phrases))))
    tf |= dict.fromkeys((p for p in tree.phrases() if not p.words), F.lit(0))
    matching = found.where(fulltext.matches(tree, tf)).crossJoin(F.broadcast(holders))  # one row
    mean = stats["all_words"] / stats["all_docs"] if stats["all_docs"] else 0.0
    rank = F.lit(0.0)
    for p in fulltext.scored(tree):
        if p.words:
            i = phrases.index(p)
            rank = rank - fulltext.weight(F.lit(stats["all_docs"]), F.col(f"df_{i}"), tf[p], F.col("doc_len"), F.lit(mean))
    return matching.select("number", rank.alias("rank"))


def search(index: Index, query: str, limit: int, *, decimals: int | None = None) -> DataFrame:
    """The best rows, as key (under the index's name of it) and rank: by rank, then key, as numbers are in order of keys.

    With `decimals`, ranks are rounded before they are ordered, so that those equal to so many places are ordered by key.
    """
    found = match(index, query)
    if decimals is not None:
        found = found.withColumn("rank", F.round("rank", decimals))
    best = found.orderBy("rank", "number").limit(limit)
    return index.table("documents").select("number", F.col("key").alias(index.key)).join(F.broadcast(best), "number").orderBy("rank", "number").select(index.key, "rank")  # `limit` rows


def orphans(index: Index, docs: DataFrame) -> DataFrame:
    """code and key: documents of the index that aren't among the rows, and rows that the index hasn't got."""
    own, given = index.table("documents").select(F.col("key").cast("string").alias("key")), docs.select(F.col(index.key).cast("string").alias("key"))
    lost = own.join(given, "key", "left_anti").distinct().select(F.lit("posting_without_row").alias("code"), "key")
    return lost.unionByName(given.join(own, "key", "left_anti").distinct().select(F.lit("row_without_posting").alias("code"), "key"))


def row_counts(index: Index) -> DataFrame:
    """For each column: rows with words in it, its words, and its distinct terms."""
    docs = index.table("documents")
    held = docs.agg(*(F.struct(F.count_if(F.col(f"words_{i}") > 0).alias("documents"), F.coalesce(F.sum(F.col(f"words_{i}").cast("long")), F.lit(0)).alias("words")).alias(f"x{i}") for i in range(len(index.columns))))
    rows = held.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("column"), F.col(f"x{i}.documents").alias("documents"), F.col(f"x{i}.words").alias("words")) for i, c in enumerate(index.columns)))))
    terms = index.table("terms").groupBy("column").agg(F.count(F.lit(1)).alias("terms"))
    return rows.join(F.broadcast(terms), "column", "left").select("column_name", "documents", "words", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))  # a row for each column
