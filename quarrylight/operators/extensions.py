"""Extensions: operators that are described but were never part of the query menu."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text

# Weights of the parts of a score, and the thresholds of its classes.
WEIGHTS = {"semantic": 0.40, "symbol": 0.25, "keyword": 0.15, "graph": 0.15, "file_type": 0.05}
STRONG, POSSIBLE = 0.55, 0.35


def weighted_score(**parts: Column) -> Column:
    """The weighted sum of the parts given; missing ones count 0."""
    unknown = parts.keys() - WEIGHTS.keys()
    if unknown:
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    return sum((F.coalesce(v, F.lit(0.0)) * WEIGHTS[k] for k, v in sorted(parts.items())), F.lit(0.0))


def match_class(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= POSSIBLE, "possible").otherwise("none")


def keyword_score(body: Column, query: str) -> Column:
    """1 for the whole phrase, 0.7 if all words occur, 0.4 if some do, else 0."""
    words = [w for w in query.lower().split() if w]
    low = text.ascii_lower(body)
    found = [F.contains(low, F.lit(w)).cast("int") for w in words]
    n = sum(found[1:], found[0]) if found else F.lit(0)
    return F.when(F.contains(low, F.lit(" ".join(words))), 1.0).when(n == len(words), 0.7).when(n > 0, 0.4).otherwise(0.0)


def risk_level(callers: Column, *, route: Column | None = None, untested: Column | None = None) -> Column:
    """low up to 2 callers, medium up to 5, high from 6; a route or missing tests make it medium at least."""
    level = F.when(callers >= 6, 2).when(callers >= 3, 1).otherwise(0)
    for more in (route, untested):
        if more is not None:
            level = F.greatest(level, F.when(more, 1).otherwise(0))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1)


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """folder and n_files; files at the top are in '.'."""
    parent = F.when(F.contains(F.col(path), F.lit("/")), F.regexp_replace(F.col(path), "/[^/]*$", "")).otherwise(".")
    return files.groupBy(parent.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, n_in, n_out and degree of every node with an edge; each edge is read once."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("source_node_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_node_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("degree", F.col("n_in") + F.col("n_out"))


def most_connected(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node_id").limit(k)


def files_with_most_symbols(symbols: DataFrame, files: DataFrame, k: int, *, key: str = "file_id", file_key: str = "id", path: str = "path") -> DataFrame:
    """path, n_symbols and share (of all symbols, to four digits) of the k files that hold most; ties in order of the path."""
    held = symbols.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n_symbols"))
    whole = held.agg(F.sum("n_symbols").alias("whole"))  # one row
    named = held.join(files.select(F.col(file_key).alias("k"), F.col(path).alias("path")), "k").crossJoin(F.broadcast(whole))
    return named.select("path", "n_symbols", F.round(F.col("n_symbols") / F.col("whole"), 4).alias("share")).orderBy(F.desc("n_symbols"), "path").limit(k)
