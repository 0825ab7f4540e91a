"""Constraint checks: each gives code and key of the rows that break it; no rows means valid."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.functions import vectors
from quarrylight.sources import scan


def broken(df: DataFrame, key: str, **rules: Column) -> DataFrame:
    """A row for each rule (true means broken; null doesn't) and row that breaks it, in one pass."""
    codes = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda c: c.isNotNull())
    return df.select(F.explode(codes).alias("code"), F.col(key).cast("string").alias("key"))


def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(code).alias("code"), "key")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, code: str) -> DataFrame:
    """Distinct values of a column, nulls aside, that the parent's key doesn't have."""
    values = child.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct()
    return values.join(parent.select(F.col(key).alias("k")), "k", "left_anti").select(F.lit(code).alias("code"), F.col("k").cast("string").alias("key"))


def differing(a: DataFrame, b: DataFrame, key: str, code: str) -> DataFrame:
    """Keys that only one of two frames has."""
    return orphans(a, key, b, key, f"{code}_only_first").unionByName(orphans(b, key, a, key, f"{code}_only_second"))


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _not_in(column: str, domain: tuple[str, ...]) -> Column:
    return ~schemas.in_domain(column, domain)


def scanned(files: DataFrame) -> DataFrame:
    unsafe = F.col("path").rlike(r"(^|/)\.\.(/|\z)|^/|\\|^\z")
    rows = broken(files, "path", unsafe_path=unsafe, bad_file_type=_not_in("file_type", schemas.FILE_TYPES), bad_parse_status=_not_in("parse_status", schemas.PARSE_STATUSES), bad_size=~F.col("size_bytes").between(1, scan.MAX_FILE_BYTES), bad_lines=F.col("line_count") < 0, bad_hash=~F.col("content_hash").rlike("^[0-9a-f]{64}\\z"), binary_with_text=F.col("is_binary") & (F.col("text") != ""))
    return together(rows, repeated(files, "path", "duplicate_file"))


def parsed(rows: DataFrame, files: DataFrame) -> DataFrame:
    status = broken(rows, "path", bad_status=_not_in("status", schemas.PARSE_STATUSES[1:]), error_without_message=(F.col("status") == "error") & F.col("error").isNull(), symbols_without_parse=(F.col("status") != "parsed") & (F.size("symbols") > 0))
    symbols = rows.select("path", F.inline("symbols"))
    of_symbols = broken(symbols, "symbol_id", bad_symbol_type=_not_in("symbol_type", schemas.SYMBOL_TYPES), bad_range=(F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), unnamed_symbol=F.coalesce(F.col("name"), F.lit("")) == "")
    routes = rows.select("path", F.inline("routes"))
    of_routes = broken(routes, "route_id", bad_method=_not_in("method", schemas.HTTP_METHODS))
    return together(status, of_symbols, of_routes, repeated(symbols, "symbol_id", "duplicate_symbol"), repeated(rows, "path", "duplicate_parse"), orphans(rows, "path", files, "path", "parse_without_file"))


def chunks(rows: DataFrame, files: DataFrame) -> DataFrame:
    bad = broken(rows, "id", bad_chunk_type=_not_in("chunk_type", schemas.CHUNK_TYPES), blank_content=F.coalesce(F.trim("content"), F.lit("")) == "", bad_range=(F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), bad_hash=F.col("content_hash") != F.sha2("content", 256))
    return together(bad, repeated(rows, "id", "duplicate_chunk"), orphans(rows, "file_path", files.select(F.col("path").alias("file_path")), "file_path", "chunk_without_file"))


def embeddings(rows: DataFrame, chunk_rows: DataFrame, dimension: int) -> DataFrame:
    return together(broken(rows, "chunk_id", bad_vector=~vectors.is_valid(F.col("vector"), dimension)), repeated(rows, "chunk_id", "duplicate_vector"), orphans(rows, "chunk_id", chunk_rows.select(F.col("id").alias("chunk_id")), "chunk_id", "vector_without_chunk"))


def graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from quarrylight.operators import graph as g

    of_nodes = broken(nodes, "node_id", bad_node_type=_not_in("node_type", schemas.NODE_TYPES), bad_confidence=_not_in("confidence", schemas.CONFIDENCES), bad_record_id=~F.col("id").rlike("^gn:[0-9a-f]{64}\\z"))
    of_edges = broken(edges, "id", bad_relation=_not_in("relation", schemas.RELATIONS), bad_confidence=_not_in("confidence", schemas.CONFIDENCES), bad_record_id=~F.col("id").rlike("^ge:[0-9a-f]{64}\\z"))
    return together(of_nodes, of_edges, g.violations(nodes, edges))


def sanitized(message: str, root: str = "") -> str:
    """A message in one line of 500 characters at most, without this machine's paths: the root's become relative, others <path>."""
    if root:
        message = message.replace(root.rstrip("/") + "/", "").replace(root, ".")
    message = re.sub(r"(?:[A-Za-z]:)?(?:[/\\][\w.@+~ -]+){2,}", "<path>", message)
    return re.sub(r"[\x00-\x1f\x7f]+", " ", message).strip()[:500]


def as_diagnostics(violations: DataFrame, stage: str) -> DataFrame:
    """Violations as fatal diagnostics, messages of 500 characters at most."""
    return violations.select(F.concat(F.lit(f"{stage}_"), "code").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("file_path"), F.substring(F.concat_ws(": ", "code", "key"), 1, 500).alias("message"))
