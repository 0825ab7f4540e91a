"""Rules that the artifacts of a build must keep, as tables, and one engine that runs them.

A rule is a condition of a row, a key that may not repeat, a key that another artifact must have, or a count that must hold. All row
rules of an artifact are one expression in one pass, all keys that may not repeat one aggregation, and all keys that must be known to
an artifact one anti-join. A repeated key is told at its last row. The first violation is that of the first row in the artifact's order, then
of the first rule in the table's order; counts come after all rows. Types are given by schemas, so no rule looks at them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.sources import scan

SCHEMA = "artifact string, rule string, place long, priority int, key string, message string, file_path string"


@dataclass(frozen=True)
class Rule:
    """`broken` is true for bad rows (null isn't); or `unique` names a column; or `known` a column and (artifact, column) that has its values."""

    name: str
    message: str
    broken: Callable[[], Column] | None = None
    unique: tuple[str, ...] | None = None
    known: tuple[str, str, str] | None = None


def _blank(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(name), F.lit("")) == ""


def _outside(name: str, domain: tuple[str, ...]) -> Callable[[], Column]:
    return lambda: ~schemas.in_domain(name, domain)


def _path_rules(name: str, what: str) -> list[Rule]:
    part = lambda: F.split(F.col(name), "/")
    return [
        Rule("absolute_path", f"The {what} is absolute.", lambda: F.col(name).rlike(r"^[/\\]")),
        Rule("path_leaves_root", f"The {what} leaves its root.", lambda: F.array_contains(part(), "..")),
        Rule("backslash_in_path", f"The {what} has backslashes.", lambda: F.contains(F.col(name), F.lit("\\"))),
    ]


_RANGE = [Rule("bad_first_line", "The first line is below 1.", lambda: F.col("start_line") < 1), Rule("bad_last_line", "The last line is above the first.", lambda: F.col("end_line") < F.col("start_line"))]

#: By artifact, in the order in which violations lead.
RULES: dict[str, list[Rule]] = {
    "files": [
        Rule("no_path", "A scanned file has no path.", _blank("path")),
        *_path_rules("path", "path of a scanned file"),
        Rule("repeated_path", "A path was scanned twice.", unique=("path",)),
        Rule("bad_file_type", "A scanned file has an unknown type.", _outside("file_type", schemas.FILE_TYPES)),
        Rule("bad_parse_status", "A scanned file has an unknown status.", _outside("parse_status", schemas.PARSE_STATUSES)),
        Rule("bad_size", "A scanned file is empty or over the limit.", lambda: ~F.col("size_bytes").between(1, scan.MAX_FILE_BYTES)),
        Rule("bad_line_count", "A scanned file has a negative number of lines.", lambda: F.col("line_count") < 0),
        Rule("bad_content_hash", "The hash of a scanned file isn't SHA-256.", lambda: ~F.col("content_hash").rlike("^[0-9a-f]{64}\\z")),
        Rule("text_of_binary", "A binary file has text.", lambda: F.col("is_binary") & (F.col("text") != "")),
    ],
    "parsed": [
        Rule("unknown_file", "A parsed file wasn't scanned.", known=("path", "files", "path")),
        Rule("repeated_parse", "A file was parsed twice.", unique=("path",)),
        Rule("unsettled_status", "A parsed file still waits.", _outside("status", schemas.PARSE_STATUSES[1:])),
        Rule("error_without_reason", "A file that can't be parsed has no reason.", lambda: (F.col("status") == "error") & F.col("error").isNull()),
        Rule("symbols_without_parse", "A file that wasn't parsed has symbols.", lambda: (F.col("status") != "parsed") & (F.size("symbols") > 0)),
    ],
    "symbols": [
        Rule("no_symbol_id", "A symbol has no id.", _blank("symbol_id")),
        Rule("repeated_symbol_id", "Two symbols have one id.", unique=("symbol_id",)),
        Rule("no_symbol_name", "A symbol has no name.", _blank("name")),
        Rule("bad_symbol_type", "A symbol has an unknown type.", _outside("symbol_type", schemas.SYMBOL_TYPES)),
        *_RANGE,
    ],
    "routes": [
        Rule("no_route_id", "A route has no id.", _blank("route_id")),
        Rule("repeated_route_id", "Two routes have one id.", unique=("route_id",)),
        Rule("bad_method", "A route has an unknown method.", _outside("method", schemas.HTTP_METHODS)),
    ],
    "chunks": [
        Rule("no_chunk_id", "A chunk has no id.", _blank("id")),
        Rule("repeated_chunk_id", "Two chunks have one id.", unique=("id",)),
        Rule("unknown_file", "A chunk is of a file that wasn't scanned.", known=("file_path", "files", "path")),
        *_path_rules("file_path", "path of a chunk"),
        *_RANGE,
        Rule("blank_content", "A chunk has no content.", lambda: ~F.coalesce(F.col("content"), F.lit("")).rlike(r"\S")),
        Rule("bad_content_hash", "The hash of a chunk isn't that of its content.", lambda: (F.col("content_hash") != "") & (F.col("content_hash") != F.sha2("content", 256))),
        Rule("bad_chunk_type", "A chunk has an unknown type.", _outside("chunk_type", schemas.CHUNK_TYPES)),
    ],
    "embeddings": [
        Rule("no_chunk_id", "A vector has no chunk.", _blank("chunk_id")),
        Rule("repeated_chunk_id", "A chunk has two vectors.", unique=("chunk_id",)),
        Rule("unknown_chunk", "A vector is of an unknown chunk.", known=("chunk_id", "chunks", "id")),
        Rule("bad_width", "A vector hasn't the encoder's width.", lambda: F.coalesce(F.size("vector") != F.col("width"), F.lit(True))),
        Rule("bad_number", "A vector holds something that isn't a finite number.", lambda: F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))),
        *_path_rules("file_path", "path of a vector"),
    ],
    "nodes": [
        Rule("no_node_id", "A node has no id.", _blank("node_id")),
        Rule("repeated_node_id", "Two nodes have one id.", unique=("node_id",)),
        Rule("no_record_id", "A node has no record id.", _blank("id")),
        Rule("repeated_record_id", "Two nodes have one record id.", unique=("id",)),
        Rule("bad_node_type", "A node has an unknown type.", _outside("node_type", schemas.NODE_TYPES)),
        Rule("bad_confidence", "A node has an unknown confidence.", _outside("confidence", schemas.CONFIDENCES)),
        *_path_rules("source_file", "source file of a node"),
    ],
    "edges": [
        Rule("no_record_id", "An edge has no record id.", _blank("id")),
        Rule("repeated_record_id", "Two edges have one record id.", unique=("id",)),
        Rule("repeated_edge", "An edge occurs twice.", unique=("source_node_id", "target_node_id", "relation", "source_file", "source_location")),
        Rule("no_source", "An edge has no source.", _blank("source_node_id")),
        Rule("no_target", "An edge has no target.", _blank("target_node_id")),
        Rule("bad_relation", "An edge has an unknown relation.", _outside("relation", schemas.RELATIONS)),
        Rule("bad_confidence", "An edge has an unknown confidence.", _outside("confidence", schemas.CONFIDENCES)),
        Rule("unknown_source", "The source of an edge is no node.", known=("source_node_id", "nodes", "node_id")),
        Rule("unknown_target", "The target of an edge is no node.", known=("target_node_id", "nodes", "node_id")),
        *_path_rules("source_file", "source file of an edge"),
    ],
}

#: Column that a violation names, and the one with its path, by artifact.
KEYS = {"files": ("path", "path"), "parsed": ("path", "path"), "symbols": ("symbol_id", "path"), "routes": ("route_id", "path"), "chunks": ("id", "file_path"), "embeddings": ("chunk_id", "file_path"), "nodes": ("node_id", "source_file"), "edges": ("id", "source_file")}

# A place after all rows, for counts.
_LAST = (1 << 63) - 1


def _row(artifact: str, rule: Rule, priority: int, place: Column, key: Column, path: Column) -> list[Column]:
    safe = F.when(~path.rlike(r"^[/\\]") & ~F.array_contains(F.split(path, r"[/\\]"), ".."), F.translate(path, "\\", "/"))
    return [F.lit(artifact).alias("artifact"), F.lit(rule.name).alias("rule"), place.cast("long").alias("place"), F.lit(priority).alias("priority"), F.substring(key.cast("string"), 1, 500).alias("key"), F.lit(rule.message).alias("message"), safe.alias("file_path")]


def violations(artifact: str, frames: dict[str, DataFrame], order: str | None = None) -> DataFrame:
    """SCHEMA: every violation in one artifact; `frames` has it and those that its rules look into.

    `order` names its numeric column of places; without one, keys decide by their hash, which is the same in every run.
    """
    df, (key, path) = frames[artifact], KEYS[artifact]
    if artifact not in ("files", "parsed", "symbols", "routes", "chunks", "embeddings", "nodes", "edges"):
        raise ValueError(f"no rules for {artifact}")
    if "source_file" == path and artifact == "edges" and "source_location" not in df.columns:
        df = df.withColumn("source_location", F.lit(None).cast("string"))
    place = F.col(order) if order else F.xxhash64(key).bitwiseAND(F.lit(_LAST >> 1))
    df = df.withColumn("__place", place.cast("long"))
    rules = RULES[artifact]
    row = lambda i, at, k, where: F.struct(*_row(artifact, rules[i], i, at, k, where))
    tests = [F.when(F.coalesce(rule.broken(), F.lit(False)), row(i, F.col("__place"), F.col(key), F.col(path))) for i, rule in enumerate(rules) if rule.broken]
    found = [df.select(F.inline(F.filter(F.array(*tests), lambda x: x.isNotNull())))]

    def told(i: Column, which: list[int], at: str, k: str, where: str) -> Column:
        """The row of the rule whose number is in a column."""
        out = F.when(i == which[0], row(which[0], F.col(at), F.col(k), F.col(where)))
        for other in which[1:]:
            out = out.when(i == other, row(other, F.col(at), F.col(k), F.col(where)))
        return out

    unique = [i for i, rule in enumerate(rules) if rule.unique]
    if unique:
        value = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
        keys = F.array(*(F.struct(F.lit(i).alias("i"), F.to_json(F.array(*map(value, rules[i].unique))).alias("v")) for i in unique))
        met = df.select(F.col("__place").alias("at"), F.col(key).alias("key"), F.col(path).alias("path"), F.inline(keys))
        twice = met.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "key", "path")).alias("x")).where("n > 1")
        found.append(twice.select(told(F.col("i"), unique, "x.at", "x.key", "x.path").alias("y")).select("y.*"))
    others = {rule.known[1:] for rule in rules if rule.known}
    for other, name in sorted(others):
        known = [i for i, rule in enumerate(rules) if rule.known and rule.known[1:] == (other, name)]
        values = F.array(*(F.struct(F.lit(i).alias("i"), F.col(rules[i].known[0]).alias("v")) for i in known))
        asked = df.select(F.col("__place").alias("at"), F.col(key).alias("key"), F.col(path).alias("path"), F.inline(values)).where("v <> ''")
        lost = asked.join(frames[other].select(F.col(name).alias("v")).distinct(), "v", "left_anti")
        found.append(lost.select(told(F.col("i"), known, "at", "key", "path").alias("y")).select("y.*"))
    return reduce(DataFrame.unionByName, found)


def counted(artifact: str, df: DataFrame, said: int) -> DataFrame:
    """A violation if a count that was told isn't the number of rows."""
    rule = Rule("wrong_count", f"The number of {artifact} isn't what was told.")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") != said).select(*_row(artifact, rule, len(RULES[artifact]), F.lit(_LAST), F.concat_ws(" ", F.lit(str(said)), F.col("n").cast("string")), F.lit(None).cast("string")))


def first(found: DataFrame) -> DataFrame:
    """The leading violation of each artifact, or no row; one aggregation."""
    lead = found.groupBy("artifact").agg(F.min(F.struct("place", "priority", "key", "rule", "message", "file_path")).alias("x"))
    return lead.select("artifact", "x.rule", "x.place", "x.priority", "x.key", "x.message", "x.file_path")


def as_diagnostics(found: DataFrame) -> DataFrame:
    """schemas.DIAGNOSTICS of violations: fixed messages, and only paths that are relative and stay inside."""
    return found.select(F.concat_ws("_", "artifact", "rule").alias("code"), F.lit("error").alias("severity"), "file_path", "message")


def broken_counters(counts: dict[str, int]) -> list[str]:
    """Which counters of a build contradict each other; those that are missing are not looked at."""
    have = lambda *names: all(n in counts for n in names)
    out = [f"{k} is not a count" for k, v in sorted(counts.items()) if isinstance(v, bool) or not isinstance(v, int) or v < 0]
    if out:
        return out
    if have("files", "parsed", "not_applicable", "errors") and counts["files"] != counts["parsed"] + counts["not_applicable"] + counts["errors"]:
        out.append("files are not the parsed, not applicable and failed ones")
    for part, whole in (("routes", "symbols"), ("vectors", "chunks"), ("imports", "nodes"), ("tests", "nodes")):
        if have(part, whole) and counts[part] > counts[whole]:
            out.append(f"more {part} than {whole}")
    if have("nodes", "edges") and counts["edges"] and not counts["nodes"]:
        out.append("edges without nodes")
    return out
