"""Code search: text hits, nearest vectors, and both together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.functions import text, vectors
from quarrylight.operators import fulltext, inverted

# Fixed values.
SEMANTIC_HITS, SHOWN = 50, 500
CHUNK_COLUMNS = ("content", "symbol_name", "file_path")


def _searched(rows: DataFrame, columns: tuple[str, ...], query: str, limit: int, index: inverted.Index | None, fallback: str | None) -> DataFrame:
    """The best rows, with rank. With an index, no text is read but that of the hits; other queries than the language's look for substrings."""
    if index is None:
        return fulltext.search(rows, columns, query, limit, fallback=fallback)
    try:
        best = inverted.search(index, query, limit).collect()  # `limit` rows
    except fulltext.QuerySyntaxError:
        return fulltext.search(rows, columns, query, limit, fallback=fallback)
    ranks = rows.sparkSession.createDataFrame([(r["id"], r["rank"]) for r in best], "id string, rank double")
    found = rows.where(F.col("id").isin([r["id"] for r in best])) if best else rows.where(F.lit(False))  # literals reach the scan
    return found.join(F.broadcast(ranks), "id").orderBy("rank", "id")


def text_hits(chunks: DataFrame, query: str, limit: int, *, relevance_fix: bool = False, index: inverted.Index | None = None) -> DataFrame:
    """schemas.SEARCH_HIT by full text. Scores fall as relevance grows unless `relevance_fix` turns them round."""
    found = _searched(chunks, CHUNK_COLUMNS, query, limit, index, "content")
    score = fulltext.rank_to_score(F.col("rank"))
    if relevance_fix:
        score = F.when(F.col("rank").isNull(), 0.0).otherwise(1 - score)
    return _hits(found, F.col("id"), F.substring(F.coalesce("content", F.lit("")), 1, SHOWN), text_score=score, source="text")


def symbol_hits(symbols: DataFrame, query: str, limit: int, *, index: inverted.Index | None = None) -> DataFrame:
    """Symbols by full text over name and qualified name, with rank; other queries look for a part of the name."""
    return _searched(symbols, ("name", "qualified_name"), query, limit, index, "name")


def indexed_hits(chunks: DataFrame, query: str, limit: int, *, index: inverted.Index | None = None) -> DataFrame:
    """Chunks by full text alone, with rank: queries outside the language find nothing."""
    return _searched(chunks, CHUNK_COLUMNS, query, limit, index, None)


def nearest(vectors_table: DataFrame, query: list[float], k: int, *, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k rows of greatest cosine similarity, with score between 0 and 1; ties in order of the key."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors_table.withColumn("score", vectors.clamped(vectors.cosine(F.col(vector), literal)))
    return scored.orderBy(F.desc("score"), key).limit(k)


def semantic_hits(embeddings: DataFrame, query: list[float], limit: int = SEMANTIC_HITS) -> DataFrame:
    """schemas.SEARCH_HIT by cosine similarity; nothing is shown of the text."""
    found = nearest(embeddings, query, limit)
    return _hits(found, F.col("chunk_id"), F.lit(""), semantic_score=F.col("score"), source="semantic")


def _hits(found: DataFrame, key, shown, *, text_score=None, semantic_score=None, source: str) -> DataFrame:
    none = F.lit(None).cast("double")
    score = text_score if text_score is not None else semantic_score
    out = found.select(
        key.alias("chunk_id"),
        text.posix(F.col("file_path")).alias("source_path"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"),
        F.coalesce("end_line", F.lit(0)).alias("end_line"),
        F.col("chunk_type").alias("chunk_kind"),
        F.nullif(F.col("symbol_name"), F.lit("")).alias("owner_semantic_key"),
        shown.alias("display_text"),
        (none if text_score is None else text_score).alias("text_score"),
        (none if semantic_score is None else semantic_score).alias("semantic_score"),
        score.alias("combined_score"),
        F.lit(source).alias("match_source"),
    )
    return out.select(*schemas.SEARCH_HIT.names)


def merged(text_rows: DataFrame, semantic_rows: DataFrame, limit: int) -> DataFrame:
    """Hits of both kinds by chunk: the greater score counts, the text hit's excerpt is shown."""
    t, s = text_rows.alias("t"), semantic_rows.alias("s")
    both = t.join(s, F.col("t.chunk_id") == F.col("s.chunk_id"), "full")
    places = ("source_path", "start_line", "end_line", "chunk_kind", "owner_semantic_key")
    out = both.select(
        F.coalesce("t.chunk_id", "s.chunk_id").alias("chunk_id"),
        *(F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in places),
        F.coalesce(F.nullif(F.col("t.display_text"), F.lit("")), F.col("s.display_text"), F.lit("")).alias("display_text"),
        F.col("t.text_score"),
        F.col("s.semantic_score"),
        F.greatest(F.coalesce("t.text_score", F.lit(0.0)), F.coalesce("s.semantic_score", F.lit(0.0))).alias("combined_score"),
        F.when(F.col("t.chunk_id").isNull(), "semantic").when(F.col("s.chunk_id").isNull(), "text").otherwise("both").alias("match_source"),
    )
    return out.orderBy(F.desc("combined_score"), "chunk_id").limit(limit)
