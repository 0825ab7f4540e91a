"""Further tools over the query service: symbols with their callers, files in context, related files and tests, impact of a change, and
whether something exists already. Each gives a dict of plain values; lists are bounded by `limit`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import bands, extensions, paths, search
from quarrylight.operators.embed import EncoderUnavailable
from quarrylight.plans.service import QueryService, QueryValidationError, check_choice, check_limit, check_query

# Kinds of change, and how many candidates each search gives.
CHANGE_TYPES = ("modify_function", "delete_file", "change_signature")
CANDIDATES = 10


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Contracts:
    """The tools over one repository."""

    def __init__(self, service: QueryService):
        self.service = service

    def _symbols(self) -> DataFrame:
        """symbols with file_path and node_id, the id of a test's own node included."""
        symbols, files, nodes = self.service._tables("symbols", "files", "nodes")
        placed = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "line_count", "language", "file_type"), "file_id")
        test = F.concat_ws(":", F.lit("test"), "file_path", "name", F.col("start_line").cast("string"))
        known = nodes.select("node_id")
        of_symbol = placed.join(known, placed["id"] == known["node_id"])
        return of_symbol.unionByName(placed.withColumn("node_id", test).join(known, "node_id").select(*of_symbol.columns))

    def _targets(self, target: str) -> DataFrame:
        """node_id of a file and all in it, or of all nodes with a name."""
        (nodes,) = self.service._tables("nodes")
        return nodes.where((text.posix(F.col("source_file")) == target) | (F.col("label") == target) | (F.col("node_id") == target)).select("node_id").distinct()

    def find_symbol(self, name: str, symbol_type: str | None = None, limit: int = 100) -> dict:
        """Symbols of exactly that name; `calls` as written in the code, `called_by` names of callers in order, `limit` at most."""
        check_query(name)
        check_limit(limit)
        edges, nodes = self.service._tables("edges", "nodes")
        wanted = F.col("name") == name
        if symbol_type:
            wanted = wanted & (F.col("symbol_type") == symbol_type.lower())
        found = self._symbols().where(wanted).orderBy("file_path", "start_line", "id").limit(limit)
        called = edges.where("relation = 'calls'").select("source_node_id", F.col("target_node_id").alias("node_id")).join(found.select("node_id"), "node_id", "left_semi")
        named = called.join(nodes.select(F.col("node_id").alias("source_node_id"), F.col("label").alias("caller")), "source_node_id").select("node_id", "caller").distinct()
        first = named.withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy("caller"))).where(F.col("n") <= limit)
        callers = first.groupBy("node_id").agg(F.sort_array(F.collect_list("caller")).alias("called_by"))
        calls = F.from_json(F.get_json_object("metadata", "$.calls"), "array<string>")
        none = F.array().cast("array<string>")
        out = found.join(callers, "node_id", "left").select("id", "name", "qualified_name", "symbol_type", "file_path", "start_line", "end_line", "signature", "docstring", F.coalesce(calls, none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))
        rows = _rows(out.orderBy("file_path", "start_line", "id"))
        return {"results": rows, "total_results": len(rows)}

    def get_file_context(self, file_path: str, limit: int = 100) -> dict:
        """What a file holds, imports and is linked to; an error for files that aren't indexed."""
        check_query(file_path)
        check_limit(limit)
        files, symbols, chunks, edges, nodes = self.service._tables("files", "symbols", "chunks", "edges", "nodes")
        file = files.where(F.col("path") == file_path).first()
        if file is None:
            return {"error": "file_not_found", "file_path": file_path}
        own = symbols.where(F.col("file_id") == file["id"])
        held = own.where("symbol_type <> 'route'").orderBy("start_line", "id").limit(limit).select("name", F.col("symbol_type").alias("type"), "start_line", "end_line", "signature")
        routes = own.where("symbol_type = 'route'").orderBy("start_line", "id").limit(limit).select(F.get_json_object("metadata", "$.http_method").alias("method"), F.get_json_object("metadata", "$.route_path").alias("route_path"), F.get_json_object("metadata", "$.handler_function").alias("handler"), "start_line")
        field = lambda n: F.get_json_object("metadata", f"$.{n}")
        brought = edges.where((F.col("relation") == "imports") & (F.col("source_node_id") == f"file:{file_path}"))
        imports = brought.select(field("module_name").alias("module_name"), F.from_json(field("imported_names"), "array<string>").alias("imported_names"), field("alias").alias("alias"), field("line_number").cast("int").alias("line_number")).orderBy("line_number", "module_name", "imported_names").limit(limit)
        summary = chunks.where((F.col("file_path") == file_path) & (F.col("chunk_type") == "file_summary")).select(F.substring("content", 1, search.SHOWN).alias("x")).first()
        near = paths.related_files(edges, nodes, self._targets(file_path), 1).orderBy("file_path").limit(limit)
        return {"file_path": file_path, "language": file["language"], "line_count": file["line_count"], "summary": summary["x"] if summary else "", "symbols": _rows(held), "imports": _rows(imports), "routes": _rows(routes), "related_files": [r["file_path"] for r in near.collect()]}

    def find_related_files(self, target: str, max_hops: int = 2, relation_types: list[str] | None = None, limit: int = 100) -> dict:
        """Files within some hops of a file or symbol, in any direction; nothing for unknown targets."""
        check_query(target)
        check_limit(limit)
        if isinstance(max_hops, bool) or not isinstance(max_hops, int) or not 1 <= max_hops <= paths.MAX_HOPS:
            raise QueryValidationError(f"max_hops must be a whole number from 1 to {paths.MAX_HOPS}.")
        edges, nodes = self.service._tables("edges", "nodes")
        found = paths.related_files(edges, nodes, self._targets(target), max_hops, relation_types).cache()
        try:
            rows = _rows(found.orderBy("hop_count", "file_path").limit(limit).select("file_path", "relation", "confidence", "hop_count"))
            return {"target": target, "related_files": rows, "total_related": found.count()}
        finally:
            found.unpersist()

    def find_related_tests(self, target: str, limit: int = 100) -> dict:
        """Tests with an edge to the target, and tests in files that are named after the target's file."""
        check_query(target)
        check_limit(limit)
        (edges,) = self.service._tables("edges")
        tests = self._symbols().where("symbol_type in ('function', 'method')")
        linked = edges.where("relation = 'tests'").join(self._targets(target).select(F.col("node_id").alias("target_node_id")), "target_node_id", "left_semi")
        by_edge = tests.join(linked.select(F.col("source_node_id").alias("node_id"), "confidence").distinct(), "node_id").select("file_path", "name", "start_line", F.lit("tests").alias("relation"), "confidence")
        stem = target.rsplit("/", 1)[-1].removesuffix(".py")
        file_name = text.basename(F.col("file_path"))
        by_name = tests.where(file_name.isin(f"test_{stem}.py", f"{stem}_test.py") & F.col("name").startswith("test")).select("file_path", "name", "start_line", F.lit("naming").alias("relation"), F.lit("INFERRED").alias("confidence"))
        lead = by_edge.unionByName(by_name).groupBy("file_path", "name", "start_line").agg(F.max(F.struct("relation", "confidence")).alias("x"))
        rows = _rows(lead.select("file_path", "name", "start_line", "x.relation", "x.confidence").orderBy("file_path", "start_line").limit(limit))
        files: dict[str, dict] = {}
        for r in rows:
            one = files.setdefault(r["file_path"], {"file_path": r["file_path"], "test_functions": [], "relation": r["relation"], "confidence": r["confidence"]})
            one["test_functions"].append({"name": r["name"], "line": r["start_line"]})
        return {"target": target, "related_tests": list(files.values()), "total_test_files": len(files), "total_test_functions": len(rows)}

    def explain_change_impact(self, target: str, change_type: str = "modify_function", function_name: str | None = None, limit: int = 100) -> dict:
        """Who calls what changes, directly and over further hops, and which tests are affected."""
        check_query(target)
        check_limit(limit)
        change_type = check_choice(change_type, CHANGE_TYPES, "change_type")
        edges, nodes = self.service._tables("edges", "nodes")
        starts = self._targets(target)
        if function_name:
            starts = starts.join(nodes.where(F.col("label") == function_name).select("node_id"), "node_id", "left_semi")
        answer = {"target": target, "change_type": change_type, "function_name": function_name}
        if not starts.take(1):
            return answer | {"impact": None}
        reached = paths.reach(paths.links(edges, "incoming", ["calls", "tests"]), starts, paths.MAX_HOPS).where("hops > 0").groupBy("node_id").agg(F.min(F.struct("hops", "relation")).alias("x"))
        outside = reached.join(starts, "node_id", "left_anti").join(nodes.select("node_id", "label", "node_type", "source_file", "source_location"), "node_id")
        place = F.regexp_extract("source_location", r":(\d+)\z", 1)
        rows = _rows(outside.select(F.col("x.hops").alias("hops"), F.col("x.relation").alias("relation"), "node_type", F.col("source_file").alias("file"), F.col("label").alias("function"), F.when(place != "", place.cast("int")).alias("line")).orderBy("hops", "file", "line", "function").limit(limit))
        pick = lambda test, keys: [{k: r[k] for k in keys} for r in rows if test(r)]
        direct = pick(lambda r: r["hops"] == 1 and r["node_type"] != "test", ("file", "function", "line"))
        further = pick(lambda r: r["hops"] > 1 and r["node_type"] != "test", ("file", "function", "line"))
        affected = pick(lambda r: r["node_type"] == "test", ("file", "function"))
        is_route = bool(nodes.join(starts, "node_id", "left_semi").where("node_type = 'route'").take(1))
        one = self.service.spark.range(1).select(extensions.risk_level(F.lit(len(direct)), route=F.lit(is_route), untested=F.lit(not affected)).alias("level"))
        strategy = {"modify_function": "Keep the signature and what is returned.", "change_signature": "Change all callers together with the signature.", "delete_file": "Move what others call before the file goes."}[change_type]
        return answer | {"impact": {"direct_callers": direct, "indirect_callers": further, "affected_tests": affected, "risk_level": one.first()["level"], "risk_reason": f"{len(direct)} direct callers, {len(further)} indirect callers, {len(affected)} tests affected", "safe_change_strategy": strategy}}

    def check_existing_implementation(self, feature: str) -> dict:
        """Candidates by meaning, by words and by name, with one weighted score; near ties go by tie-breakers. Finding nothing is an answer."""
        check_query(feature)
        service = self.service
        active, (chunks, embeddings, edges) = service._open("chunks", "embeddings", "edges")
        hit = lambda df, column, score: df.select("source_path", F.col("owner_semantic_key").alias("owner"), "start_line", F.col("chunk_kind").alias("kind"), score.alias(column))
        words = search.text_hits(chunks, feature, CANDIDATES, index=service.store.index("chunks", active))
        shown = words.select("source_path", "owner_semantic_key", "start_line", "chunk_kind", extensions.keyword_score(F.col("display_text"), feature).alias("k"))
        by_word = hit(shown, "keyword", F.col("k"))
        none = service.spark.createDataFrame([], "source_path string, owner string, start_line int, kind string, semantic double")
        try:
            if service.encoder is None:
                raise EncoderUnavailable("no encoder")
            by_meaning = hit(search.semantic_hits(embeddings, service.encoder.encode([feature])[0], CANDIDATES), "semantic", F.col("semantic_score"))
        except EncoderUnavailable:
            by_meaning = none
        symbols = self._symbols()
        by_symbol = symbols.where(F.lower("name") == feature.strip().lower()).select(F.col("file_path").alias("source_path"), F.col("name").alias("owner"), "start_line", F.col("symbol_type").alias("kind"), F.lit(1.0).alias("symbol")).limit(CANDIDATES)
        merged = by_word.unionByName(by_meaning, allowMissingColumns=True).unionByName(by_symbol, allowMissingColumns=True)
        best = merged.where("owner is not null").groupBy("source_path", "owner").agg(F.max("semantic").alias("semantic"), F.max("keyword").alias("keyword"), F.max("symbol").alias("symbol"))
        described = symbols.select(F.col("file_path").alias("source_path"), F.col("name").alias("owner"), "symbol_type", "start_line", "end_line", "signature", "node_id", "line_count", "file_type").dropDuplicates(["source_path", "owner"])
        scored = best.join(described, ["source_path", "owner"]).join(extensions.degrees(edges).select("node_id", "degree"), "node_id", "left")
        scored = scored.withColumn("score", extensions.weighted_score(semantic=F.col("semantic"), keyword=F.col("keyword"), symbol=F.col("symbol"), graph=F.when(F.col("degree") > 0, 0.4), file_type=F.when(F.col("file_type") == "source", 1.0))).withColumn("is_exact", F.col("symbol").isNotNull())
        rows = _rows(bands.ranked(scored.where(F.col("score") >= extensions.POSSIBLE), "score", [*bands.tie_breakers(), F.col("source_path"), F.col("owner")]))  # three times CANDIDATES at most
        matches = []
        for r in rows:
            strong = [(r["semantic"] or 0) >= extensions.STRONG, (r["keyword"] or 0) >= extensions.STRONG]
            reason = "exact symbol name" if r["is_exact"] else "meaning and words agree" if all(strong) else "similar meaning" if strong[0] else "same words" if strong[1] else "linked code" if r["degree"] else "weak candidate"
            usable = r["symbol_type"] != "route" and r["file_type"] != "test"
            module = r["source_path"].removesuffix(".py").replace("/", ".")
            matches.append({"file_path": r["source_path"], "symbol_name": r["owner"], "symbol_type": r["symbol_type"], "start_line": r["start_line"], "end_line": r["end_line"], "signature": r["signature"], "match_reason": reason, "relevance_score": round(r["score"], 4), "can_reuse": usable, "reuse_suggestion": f"from {module} import {r['owner']}" if usable else None})
        sure = any(m["relevance_score"] >= extensions.STRONG for m in matches)
        said = "No implementation was found." if not matches else f"Reuse {matches[0]['symbol_name']}." if matches[0]["can_reuse"] else f"Adapt {matches[0]['symbol_name']}."
        evidence = {"semantic_matches": sum(r["semantic"] is not None for r in rows), "keyword_matches": sum(bool(r["keyword"]) for r in rows), "graph_connections": sum(r["degree"] or 0 for r in rows)}
        return {"existing": bool(matches), "confidence": "EXTRACTED" if sure or not matches else "AMBIGUOUS", "matches": matches, "recommendation": said, "evidence": evidence}
