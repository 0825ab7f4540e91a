"""Building an index: scan, parse, chunk, embed, graph, store."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import ids
from quarrylight.operators import chunk, embed, graph, parse, rules, validate
from quarrylight.plans.state import TERMINAL, BuildState
from quarrylight.plans.store import Store, StoreError
from quarrylight.sources import config as configs
from quarrylight.sources import scan

STAGES = ("scanning", "parsing", "chunking", "embedding", "graphing", "storing")


class BuildError(RuntimeError):
    """A build that failed; `code` names the first reason, `state` where."""

    def __init__(self, code: str, message: str, state: str):
        super().__init__(message)
        self.code, self.state = code, state


@dataclass
class Build:
    """What a build has made so far."""

    repo_id: str
    state: BuildState = field(default_factory=BuildState)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    generation: str | None = None

    def release(self) -> None:
        """Drops the cached frames; a build that stops before storing keeps them for its caller, who calls this."""
        for df in self.frames.values():
            df.unpersist()


def file_rows(scanned: DataFrame, parsed: DataFrame) -> DataFrame:
    """The files table: the parser's status leads; files that Python can't parse as text stay not applicable."""
    known = parsed.select("path", F.col("status").alias("found"), F.substring("error", 1, 500).alias("parse_error"))
    status = F.when(F.col("is_binary"), "not_applicable").otherwise(F.coalesce("found", "parse_status"))
    return scanned.join(known, "path", "left").select(ids.file_id(F.col("path")).alias("id"), "path", "absolute_path", F.coalesce("language", F.lit("")).alias("language"), "file_type", "size_bytes", "line_count", "content_hash", "has_secrets", status.alias("parse_status"), "parse_error")


def symbol_rows(parsed: DataFrame) -> DataFrame:
    """The symbols table; routes carry their route's fields, methods the class that holds them."""
    symbols, routes = parse.symbols(parsed), parse.routes(parsed)
    held = graph.parents(symbols).select("symbol_id", F.col("class_id").alias("parent_symbol_id"))
    own = routes.select(F.col("route_id").alias("symbol_id"), F.struct(F.array("decorator").alias("decorators"), "handler_function", F.col("method").alias("http_method"), "route_id", "route_path", "start_line").alias("route"))
    plain = F.when(F.col("calls").isNotNull() | F.col("bases").isNotNull(), F.to_json(F.struct("bases", "calls")))
    meta = F.coalesce(F.when(F.col("route").isNotNull(), F.to_json("route")), plain)
    df = symbols.join(held, "symbol_id", "left").join(own, "symbol_id", "left")
    return df.select(F.col("symbol_id").alias("id"), ids.file_id(F.col("path")).alias("file_id"), "symbol_type", "name", "qualified_name", "signature", "docstring", "start_line", "end_line", "parent_symbol_id", meta.alias("metadata"))


def build(spark: SparkSession, root: str, *, encoder: embed.Encoder | None = None, stop_after: str = "storing", include_unparsed_files: bool = False, store: Store | None = None) -> Build:
    """Runs the stages up to `stop_after`; with storing, the result is the active generation afterwards.

    Frames are cached while the build runs: each feeds several of the next ones.
    """
    if stop_after not in STAGES:
        raise ValueError(f"stop_after must be one of {', '.join(STAGES)}")
    root = os.path.abspath(root)
    conf = configs.load(root)
    encoder = encoder or embed.HashingEncoder(conf.embedding_dimension)
    made = Build(str(uuid.uuid4()))
    frames, state = made.frames, made.state

    def keep(name: str, df: DataFrame) -> DataFrame:
        frames[name] = df.cache()
        return frames[name]

    def check(violations: DataFrame) -> None:
        if bad := violations.limit(1).collect():
            raise BuildError(bad[0]["code"], f"{bad[0]['code']}: {bad[0]['key']}", state.state)

    store = store or Store(spark, Path(root, configs.FOLDER))
    began = datetime.now(timezone.utc)
    started = F.lit(began)

    def keeps_rules(frames: dict[str, DataFrame], *artifacts: str) -> None:
        found = reduce(DataFrame.unionByName, (rules.violations(a, frames) for a in artifacts))
        for bad in rules.first(found).orderBy("place", "priority").limit(1).collect():
            raise BuildError(f"{bad['artifact']}_{bad['rule']}", f"{bad['message']} {bad['key'] or ''}".strip(), state.state)

    def told(status: str, error: BaseException | None = None) -> None:
        """A line in the log of builds: what the reason was and in which stage, without the paths of this machine."""
        code = getattr(error, "code", type(error).__name__) if error else None
        message = validate.sanitized(str(error), root) if error else None
        stage = next((x for x in reversed(state.history) if x != "error"), state.state)
        store.builds().append(repo_id=made.repo_id, path=root, status=status, stage=stage, generation=made.generation, error_code=code, error_message=message, started_at=began, completed_at=datetime.now(timezone.utc))

    try:
        state.to("scanning")
        read = scan.read_contents(scan.listed(spark, root, scan.IgnoreRules.load(root, tuple(conf.ignore_files)))).cache()
        frames["read"] = read
        scanned, diagnostics = scan.judge(read, max_files=conf.max_files, max_bytes=conf.max_bytes)
        scanned, diagnostics = keep("scanned", scanned), keep("diagnostics", diagnostics)
        check(diagnostics.where("severity = 'error'").select("code", F.col("file_path").alias("key")))
        keeps_rules({"files": scanned}, "files")
        if stop_after == state.state:
            return made
        state.to("parsing")
        parsed = keep("parsed", parse.parse(scanned))
        keeps_rules({"files": scanned, "parsed": parsed, "symbols": parse.symbols(parsed), "routes": parse.routes(parsed)}, "parsed", "symbols", "routes")
        if stop_after == state.state:
            return made
        state.to("chunking")
        chunks = keep("chunks", chunk.chunks(scanned, parsed))
        keeps_rules({"files": scanned, "chunks": chunks}, "chunks")
        if stop_after == state.state:
            return made
        state.to("embedding")
        check(embed.invalid_inputs(chunks).select("code", F.col("id").alias("key")))
        encoded = keep("encoded", embed.encode(chunks, encoder))
        totals = embed.counts(chunks, encoded).first()
        if totals["eligible"] and not totals["embedded"]:
            raise BuildError("embedding_failed", "No chunk could be embedded.", state.state)
        vectors = keep("embeddings", embed.embeddings(chunks, encoded))
        failed = encoded.where("error is not null").select(F.lit("embedding_failed").alias("code"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("file_path"), F.substring(F.concat_ws(": ", "id", "error"), 1, 500).alias("message"))
        diagnostics = keep("diagnostics", diagnostics.unionByName(failed))
        if stop_after == state.state:
            return made
        state.to("graphing")
        nodes, edges = graph.build(scanned.select("path", "file_type"), parsed, include_unparsed_files=include_unparsed_files)
        nodes, edges = keep("nodes", nodes), keep("edges", edges)
        keeps_rules({"nodes": nodes, "edges": edges}, "nodes", "edges")
        files, symbols = keep("files", file_rows(scanned, parsed)), keep("symbols", symbol_rows(parsed))
        made.counts = count(frames)
        if broken := rules.broken_counters(made.counts):
            raise BuildError("counts_contradict", "; ".join(broken), state.state)
        if stop_after == state.state:
            return made
        state.to("storing")
        repo = F.lit(made.repo_id)
        now = F.current_timestamp()
        status = spark.createDataFrame([(made.repo_id, "complete", encoder.name, "fts5")], "repo_id string, status string, embedding_model string, active_search_mode string")
        status = status.select("*", started.alias("started_at"), now.alias("completed_at"), F.lit(None).cast("string").alias("error_message"), *(F.lit(v).alias(k) for k, v in made.counts.items()))
        tables = {
            "repositories": spark.createDataFrame([(made.repo_id, root)], "id string, path string").select("*", F.lit(None).cast("string").alias("content_hash"), now.alias("indexed_at")),
            "files": files.select("*", repo.alias("repo_id"), now.alias("indexed_at")),
            "symbols": symbols.withColumn("repo_id", repo),
            "chunks": chunks.withColumn("repo_id", repo),
            "embeddings": vectors.withColumn("repo_id", repo),
            "nodes": nodes.withColumn("repo_id", repo),
            "edges": edges.withColumn("repo_id", repo),
            "index_status": status,
            "diagnostics": diagnostics,
        }
        made.generation = store.replace(tables)
        state.to("complete")
        told("complete")
        return made
    except StoreError as e:
        state.to("error")
        told("error", e)
        raise BuildError(e.code, str(e), "storing") from e
    except BaseException as e:  # a failing job or an interrupt ends the build like a refusal does
        if state.state not in TERMINAL:
            state.to("error")
            told("error", e)
        raise
    finally:
        if state.state in ("complete", "error"):
            made.release()


def count(frames: dict[str, DataFrame]) -> dict[str, int]:
    """The counters of a build, one aggregation for each frame."""
    by = lambda c, v: F.count_if(F.col(c) == v)
    files = frames["files"].agg(F.count(F.lit(1)).alias("files"), by("parse_status", "parsed").alias("parsed"), by("parse_status", "not_applicable").alias("not_applicable"), by("parse_status", "error").alias("errors"))
    symbols = frames["symbols"].agg(F.count(F.lit(1)).alias("symbols"), by("symbol_type", "route").alias("routes"))
    nodes = frames["nodes"].agg(F.count(F.lit(1)).alias("nodes"), by("node_type", "import").alias("imports"), by("node_type", "test").alias("tests"))
    told = frames["diagnostics"].agg(by("severity", "warning").alias("warnings"), by("severity", "error").alias("fatal_errors"))
    out: dict[str, int] = {}
    for df in (files, symbols, nodes, told, frames["chunks"].agg(F.count(F.lit(1)).alias("chunks")), frames["embeddings"].agg(F.count(F.lit(1)).alias("vectors")), frames["edges"].agg(F.count(F.lit(1)).alias("edges"))):
        out |= df.first().asDict()
    return out
