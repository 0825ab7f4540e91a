"""The read-only queries over an indexed repository. Each resolves the active generation once."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.operators import embed, lookup, search
from quarrylight.plans.store import Store, StoreError
from quarrylight.sources import config as configs

MAX_LIMIT = 500

# What an impact result warns of.
MISSING = {
    "import_relationships": "No import relationships found (imports may not be stored as graph edges for this node type).",
    "route_relationships": "No route relationships found (node is not a route handler or no routes reference it).",
    "related_tests": "No directly related tests found (test relationships are inferred by naming convention only).",
}
NO_FILE, UNKNOWN = "No containing file relationship found.", "Symbol not found in the active index."


class QueryValidationError(ValueError):
    """An argument that a query doesn't take."""


class RepositoryNotIndexedError(RuntimeError):
    """No complete generation to read."""


def check_query(query: str) -> None:
    if not isinstance(query, str) or not query.strip():
        raise QueryValidationError("The query must not be blank.")


def check_limit(limit: int) -> None:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise QueryValidationError(f"The limit must be a whole number from 1 to {MAX_LIMIT}.")


def check_choice(value: str, choices: tuple[str, ...], what: str) -> str:
    if value.lower() not in choices:
        raise QueryValidationError(f"{what} must be one of {', '.join(choices)}.")
    return value.lower()


class QueryService:
    """Queries over the repository at `root`."""

    def __init__(self, spark: SparkSession, root: str, encoder: embed.Encoder | None = None, store: Store | None = None):
        self.spark, self.root, self.encoder = spark, os.path.abspath(root), encoder
        self.store = store or Store(spark, Path(self.root, configs.FOLDER))

    def _tables(self, *names: str) -> list[DataFrame]:
        return self._open(*names)[1]

    def _open(self, *names: str) -> tuple[str, list[DataFrame]]:
        """The active generation and tables of it."""
        try:
            active = self.store.active()
            if active is None:
                raise RepositoryNotIndexedError(f"{self.root} isn't indexed.")
            status = self.store.read("index_status", active).first()
        except StoreError as e:
            raise RepositoryNotIndexedError(f"The index of {self.root} can't be read: {e}") from e
        counts = schemas.STATUS.names[schemas.STATUS.names.index("files") :]
        if status is None or status["status"] != "complete" or any(status[c] is None for c in counts):
            raise RepositoryNotIndexedError(f"The index of {self.root} isn't complete.")
        return active, [self.store.read(n, active) for n in names]

    def repository_summary(self) -> DataFrame:
        """One row: root, generation, status, time and counts."""
        active, (status,) = self._open("index_status")
        names = {"files": "file_count", "parsed": "parsed_count", "not_applicable": "not_applicable_count", "errors": "error_count", "symbols": "symbol_count", "imports": "import_count", "routes": "route_count", "tests": "test_count", "chunks": "chunk_count", "nodes": "graph_node_count", "edges": "graph_edge_count", "warnings": "warning_count", "fatal_errors": "fatal_error_count"}
        return status.select(F.lit(self.root).alias("repository_root"), F.lit(active).alias("active_generation_id"), F.col("status").alias("index_status"), F.col("completed_at").alias("indexed_at"), *(F.col(k).alias(v) for k, v in names.items()))

    def search_code(self, query: str, limit: int = 10, mode: str = "hybrid", *, relevance_fix: bool = False) -> DataFrame:
        """schemas.SEARCH_HIT. Without an encoder, hybrid searches text only and semantic fails."""
        check_query(query)
        check_limit(limit)
        mode = check_choice(mode, schemas.SEARCH_MODES, "mode")
        active, (chunks, embeddings) = self._open("chunks", "embeddings")
        by_text = search.text_hits(chunks, query, limit, relevance_fix=relevance_fix, index=self.store.index("chunks", active)) if mode != "semantic" else None
        if mode == "text":
            return by_text
        try:
            if self.encoder is None:
                raise embed.EncoderUnavailable("no encoder")
            vector = self.encoder.encode([query])[0]
        except embed.EncoderUnavailable as e:
            if mode == "semantic":
                raise QueryValidationError("Semantic search is unavailable: no encoder could be loaded.") from e
            return by_text
        by_vector = search.semantic_hits(embeddings, vector)
        return by_vector.orderBy(F.desc("combined_score"), "chunk_id").limit(limit) if mode == "semantic" else search.merged(by_text, by_vector, limit)

    def find_symbols(self, query: str, limit: int = 20, exact: bool = False) -> DataFrame:
        check_query(query)
        check_limit(limit)
        return lookup.find_symbols(*self._tables("symbols", "files"), query, limit, exact)

    def find_routes(self, method: str | None = None, path_query: str | None = None, handler_query: str | None = None, limit: int = 50) -> DataFrame:
        check_limit(limit)
        return lookup.find_routes(*self._tables("symbols", "files"), method, path_query, handler_query, limit)

    def _node(self, nodes: DataFrame, symbols: DataFrame, key: str):
        """The node of a key, also where the key is the id of a symbol whose node has another one."""
        test = F.concat_ws(":", F.lit("test"), F.expr("substring(file_id, 6)"), "name", F.col("start_line").cast("string"))
        return lookup.resolve(nodes, key, symbols.select(F.col("id").alias("symbol_id"), test.alias("node_id"))).first()

    def get_related(self, semantic_key: str, direction: str = "both", edge_types: list[str] | None = None, depth: int = 1, limit: int = 100) -> DataFrame:
        check_query(semantic_key)
        check_limit(limit)
        if depth != 1:
            raise QueryValidationError("depth must be 1.")
        direction = check_choice(direction, schemas.DIRECTIONS, "direction")
        edges, nodes, symbols = self._tables("edges", "nodes", "symbols")
        node = self._node(nodes, symbols, semantic_key)
        if node is None:
            return self.spark.createDataFrame([], schemas.RELATED_NODE)
        return lookup.related(edges, nodes, node["node_id"], direction, edge_types, limit)

    def analyze_change_impact(self, semantic_key: str, limit: int = 100, *, tests_direction: str = "outgoing") -> dict:
        """The first-order impact as one nested result; an unknown key gives a stub with a warning."""
        check_query(semantic_key)
        check_limit(limit)
        edges, nodes, symbols = self._tables("edges", "nodes", "symbols")
        node = self._node(nodes, symbols, semantic_key)
        lists = ("direct_callers", "direct_callees", "import_relationships", "route_relationships", "related_tests")
        if node is None:
            return {"target_semantic_key": semantic_key, "target_kind": "unknown", "target_qualified_name": semantic_key, "target_source_path": "", "analysis_type": "first_order", "containing_file": None, "containing_class": None, **{k: [] for k in lists}, "warnings": [UNKNOWN]}
        rows = lookup.impact(edges, nodes, node["node_id"], limit, tests_direction=tests_direction).orderBy("category", "related_node_identity", "edge_id").collect()  # at most `limit` rows in each of seven categories
        found: dict[str, list] = {k: [] for k, *_ in lookup.IMPACT}
        for r in rows:
            if r["category"] in ("import_relationships", "route_relationships"):
                found[r["category"]].append({k: r[k] for k in schemas.RELATED_NODE.names})
            else:
                found[r["category"]].append({"semantic_key": r["record_id"], "kind": r["node_kind"], "qualified_name": r["qualified_name"], "source_path": r["source_path"], "start_line": 0, "end_line": 0, "parent_semantic_key": None})
        if node["node_type"] not in ("function", "class", "method"):
            found["related_tests"] = []
        path = (node["source_file"] or "").replace("\\", "/")
        file = found["containing_file"][0]["source_path"] if found["containing_file"] else path or None
        warnings = [NO_FILE] * (file is None) + [text for k, text in MISSING.items() if not found[k]]
        return {
            "target_semantic_key": node["id"],
            "target_kind": node["node_type"],
            "target_qualified_name": node["label"] or "",
            "target_source_path": path,
            "analysis_type": "first_order",
            "containing_file": file,
            "containing_class": found["containing_class"][0]["qualified_name"] if found["containing_class"] else None,
            **{k: found[k] for k in lists},
            "warnings": warnings,
        }

    def find_existing_implementation(self, query: str, limit: int = 10) -> dict[str, DataFrame]:
        """Text hits and symbols by part of a name, each on its own."""
        return {"code_matches": self.search_code(query, limit, "text"), "symbol_matches": self.find_symbols(query, limit)}

    def search_symbols(self, query: str, limit: int = 20) -> DataFrame:
        """Symbols by full text over their names: the columns of the symbols table and rank."""
        check_query(query)
        check_limit(limit)
        active, (symbols,) = self._open("symbols")
        return search.symbol_hits(symbols, query, limit, index=self.store.index("symbols", active))

    def builds(self) -> DataFrame:
        """schemas.BUILDS: every build that ended, failed ones too, newest first."""
        return self.store.builds().read().orderBy(F.desc("completed_at"), "id")

    def status(self) -> DataFrame:
        """The status row of the active generation."""
        return self._tables("index_status")[0]


def to_json(result: DataFrame | dict) -> str:
    """A result as JSON text; frames as lists of objects, nulls included. Results are bounded by their limits."""
    if isinstance(result, DataFrame):
        return json.dumps([r.asDict(recursive=True) for r in result.collect()], ensure_ascii=False, default=str)
    return json.dumps({k: json.loads(to_json(v)) if isinstance(v, DataFrame) else v for k, v in result.items()}, ensure_ascii=False, default=str)
