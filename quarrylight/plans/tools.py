"""The tools of agents: functions of plain arguments that return JSON text; each call opens the repository anew."""

from __future__ import annotations

import json
import os
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from quarrylight.operators import embed
from quarrylight.plans.contracts import Contracts
from quarrylight.plans.service import QueryService, QueryValidationError, RepositoryNotIndexedError, check_limit, to_json
from quarrylight.plans.store import Store
from quarrylight.sources import config as configs


class Tools:
    """All tools over one Spark session. Errors come back as {"error": ..., "code": ...}."""

    def __init__(self, spark: SparkSession, encoder: embed.Encoder | None = None):
        self.spark, self.encoder = spark, encoder

    def _logged(self, tool: str, repository_root: str, arguments: dict, limit: int | None, ask) -> str:
        """The answer, and a line about it in the repository's log of tool calls."""
        began = time.monotonic()
        said = self._answer(repository_root, limit, ask)
        if isinstance(repository_root, str) and os.path.isdir(os.path.join(repository_root, configs.FOLDER)):
            found = json.loads(said)
            failed = isinstance(found, dict) and "error" in found
            count = 0 if failed else len(found) if isinstance(found, list) else sum(len(x) for x in found.values() if isinstance(x, list))
            summary = found.get("code", found["error"]) if failed else f"{count} results"
            store = Store(self.spark, os.path.join(os.path.abspath(repository_root), configs.FOLDER))
            store.tool_calls().append(tool_name=tool, arguments=json.dumps(arguments, ensure_ascii=False, default=str)[:4000], status="error" if failed else "ok", output_summary=summary, result_count=count, duration_ms=round(1000 * (time.monotonic() - began)), created_at=datetime.now(timezone.utc))
        return said

    def _answer(self, repository_root: str, limit: int | None, ask) -> str:
        try:
            if not isinstance(repository_root, str) or not repository_root.strip():
                raise QueryValidationError("repository_root must not be blank.")
            if not os.path.isdir(repository_root):
                raise QueryValidationError(f"repository_root is not a directory: {repository_root}")
            if limit is not None:
                check_limit(limit)
            return to_json(ask(QueryService(self.spark, repository_root, self.encoder)))
        except (QueryValidationError, RepositoryNotIndexedError) as e:
            return json.dumps({"error": str(e), "code": type(e).__name__}, ensure_ascii=False)

    def repository_summary(self, repository_root: str) -> str:
        return self._logged("repository_summary", repository_root, {}, None, lambda s: s.repository_summary())

    def search_code(self, repository_root: str, query: str, mode: str = "hybrid", limit: int = 10) -> str:
        return self._logged("search_code", repository_root, {"query": query, "mode": mode, "limit": limit}, limit, lambda s: s.search_code(query, limit, mode))

    def hybrid_search(self, repository_root: str, query: str, limit: int = 10) -> str:
        return self.search_code(repository_root, query, "hybrid", limit)

    def find_symbols(self, repository_root: str, query: str, exact: bool = False, limit: int = 20) -> str:
        return self._logged("find_symbols", repository_root, {"query": query, "exact": exact, "limit": limit}, limit, lambda s: s.find_symbols(query, limit, exact))

    def find_routes(self, repository_root: str, method: str = "", path_query: str = "", handler_query: str = "", limit: int = 50) -> str:
        return self._logged("find_routes", repository_root, {"method": method, "path_query": path_query, "handler_query": handler_query, "limit": limit}, limit, lambda s: s.find_routes(method or None, path_query or None, handler_query or None, limit))

    def get_related_code(self, repository_root: str, semantic_key: str, direction: str = "both", edge_types: str = "", depth: int = 1, limit: int = 100) -> str:
        kinds = [x.strip() for x in edge_types.split(",") if x.strip()] or None
        return self._logged("get_related_code", repository_root, {"semantic_key": semantic_key, "direction": direction, "edge_types": edge_types, "depth": depth, "limit": limit}, limit, lambda s: s.get_related(semantic_key, direction, kinds, depth, limit))

    def analyze_change_impact(self, repository_root: str, semantic_key: str, limit: int = 100) -> str:
        return self._logged("analyze_change_impact", repository_root, {"semantic_key": semantic_key, "limit": limit}, limit, lambda s: s.analyze_change_impact(semantic_key, limit))

    def find_existing_implementation(self, repository_root: str, query: str, limit: int = 10) -> str:
        return self._logged("find_existing_implementation", repository_root, {"query": query, "limit": limit}, limit, lambda s: s.find_existing_implementation(query, limit))

    def find_symbol(self, repository_root: str, name: str, symbol_type: str = "", limit: int = 100) -> str:
        return self._logged("find_symbol", repository_root, {"name": name, "symbol_type": symbol_type, "limit": limit}, limit, lambda s: Contracts(s).find_symbol(name, symbol_type or None, limit))

    def get_file_context(self, repository_root: str, file_path: str, limit: int = 100) -> str:
        return self._logged("get_file_context", repository_root, {"file_path": file_path, "limit": limit}, limit, lambda s: Contracts(s).get_file_context(file_path, limit))

    def find_related_files(self, repository_root: str, target: str, max_hops: int = 2, relation_types: str = "", limit: int = 100) -> str:
        kinds = [x.strip() for x in relation_types.split(",") if x.strip()] or None
        return self._logged("find_related_files", repository_root, {"target": target, "max_hops": max_hops, "relation_types": relation_types, "limit": limit}, limit, lambda s: Contracts(s).find_related_files(target, max_hops, kinds, limit))

    def find_related_tests(self, repository_root: str, target: str, limit: int = 100) -> str:
        return self._logged("find_related_tests", repository_root, {"target": target, "limit": limit}, limit, lambda s: Contracts(s).find_related_tests(target, limit))

    def explain_change_impact(self, repository_root: str, target: str, change_type: str = "modify_function", function_name: str = "", limit: int = 100) -> str:
        return self._logged("explain_change_impact", repository_root, {"target": target, "change_type": change_type, "function_name": function_name, "limit": limit}, limit, lambda s: Contracts(s).explain_change_impact(target, change_type, function_name or None, limit))

    def check_existing_implementation(self, repository_root: str, feature: str) -> str:
        return self._logged("check_existing_implementation", repository_root, {"feature": feature}, None, lambda s: Contracts(s).check_existing_implementation(feature))
