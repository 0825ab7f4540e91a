import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylight import cli, schemas
from quarrylight.operators import embed, lookup
from quarrylight.plans import health, index
from quarrylight.plans.service import QueryService, QueryValidationError, RepositoryNotIndexedError
from quarrylight.plans.store import Store, StoreError
from quarrylight.plans.tools import Tools
from tests.fixtures import SERVICE, TWINS, make


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return make(tmp_path_factory.mktemp("service"), SERVICE)


@pytest.fixture(scope="module")
def built(spark, root):
    return index.build(spark, root, stop_after="storing")


@pytest.fixture(scope="module")
def service(spark, root, built):
    return QueryService(spark, root, embed.HashingEncoder())


def test_counts(built):
    c = built.counts
    assert (c["files"], c["parsed"], c["not_applicable"], c["errors"]) == (7, 4, 3, 0)
    assert (c["symbols"], c["imports"], c["routes"], c["tests"]) == (13, 4, 2, 1)
    assert (c["chunks"], c["vectors"], c["warnings"]) == (18, 18, 0)
    assert c["nodes"] == 4 + 8 + 2 + 4 and built.state.state == "complete"


def test_chunk_ranges(spark, root, service):
    store = Store(spark, os.path.join(root, ".quarrylight"))
    rows = {(r.file_path, r.chunk_type, r.start_line, r.end_line) for r in store.read("chunks", store.active()).collect()}
    assert {("settings.toml", "config", 1, 3), ("README.md", "readme_section", 1, 2), ("README.md", "readme_section", 3, 7), ("guide.rst", "readme_section", 1, 5)} <= rows
    assert {("pkg/api.py", "route", 16, 18), ("pkg/api.py", "route", 21, 23), ("pkg/api.py", "class", 8, 13), ("pkg/api.py", "file_summary", 1, 20), ("tests/TestApi.py", "test", 4, 5)} <= rows


def test_graph_edges(spark, root, service):
    store = Store(spark, os.path.join(root, ".quarrylight"))
    edges = store.read("edges", store.active())
    n = {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()}
    assert n == {"defines": 8 + 2 + 2, "handles_route": 2, "imports": 4, "calls": 4}


def test_summary_and_status(service):
    row = service.repository_summary().first()
    assert row.file_count == 7 and row.index_status == "complete" and row.indexed_at is not None and row.route_count == 2
    assert service.status().first().vectors == 18


def test_text_search(service):
    rows = service.search_code("tidy", mode="text").collect()
    assert rows and all(0 <= r.text_score <= 1 and r.match_source == "text" for r in rows)
    assert service.search_code("users/{user_id}", mode="text").count() >= 1  # falls back to substrings
    assert service.search_code("nothing_like_this", mode="text").count() == 0


def test_semantic_and_hybrid(service, spark, root):
    semantic = service.search_code("tidy name", 5, "semantic").collect()
    assert len(semantic) == 5 and [r.semantic_score for r in semantic] == sorted((r.semantic_score for r in semantic), reverse=True)
    hybrid = service.search_code("tidy", 50).collect()
    assert {"both"} <= {r.match_source for r in hybrid} and len({r.chunk_id for r in hybrid}) == len(hybrid)
    bare = QueryService(spark, root)
    assert {r.match_source for r in bare.search_code("tidy").collect()} == {"text"}
    with pytest.raises(QueryValidationError):
        bare.search_code("tidy", mode="semantic")


def test_symbols(service):
    assert [r.qualified_name for r in service.find_symbols("tidy", exact=True).collect()] == ["tidy"]
    assert service.find_symbols("Greeter.hello", exact=True).first().parent_semantic_key.startswith("class:")
    partial = service.find_symbols("USER").collect()
    assert {"get_user", "make_user"} <= {r.qualified_name for r in partial}
    assert service.find_symbols("g_t", 5).count() >= 1  # the underscore is a wildcard
    assert service.find_symbols("api.py").count() >= 5


def test_routes(service):
    assert service.find_routes().count() == 2
    one = service.find_routes("get", "users", "user").collect()
    assert [(r.http_method, r.route_path, r.handler_name, r.decorator_line, r.handler_end_line) for r in one] == [("GET", "/users/{user_id}", "get_user", 16, 18)]


def test_related(service):
    key = "function:pkg/tools.py:tidy:4"
    rows = service.get_related(key, "Incoming", ["calls"]).collect()
    assert {r.qualified_name for r in rows} == {"load", "hello", "make_user"} and {r.qualifier for r in rows} == {"INFERRED"}
    assert service.get_related(key, edge_types=["nonsense"]).count() == service.get_related(key).count()
    assert service.get_related("missing").count() == 0
    assert service.get_related("function:tests/TestApi.py:test_greeter:4", "incoming").count() == 1
    assert service.get_related(key, limit=1).count() == 1


def test_impact(service):
    found = service.analyze_change_impact("function:pkg/tools.py:tidy:4")
    assert len(found["direct_callers"]) == 3 and found["containing_file"] == "pkg/tools.py" and found["containing_class"] is None
    assert len(found["warnings"]) == 3
    method = service.analyze_change_impact("method:pkg/api.py:hello:9")
    assert method["containing_class"] == "Greeter" and [x["qualified_name"] for x in method["direct_callees"]] == ["tidy"]
    assert service.analyze_change_impact("route:POST:/users:pkg/api.py:21")["route_relationships"][0]["qualified_name"] == "make_user"
    assert service.analyze_change_impact("none")["target_kind"] == "unknown"


@pytest.mark.parametrize("call", [lambda s: s.search_code(" "), lambda s: s.find_symbols("x", 0), lambda s: s.find_symbols("x", 501), lambda s: s.find_symbols("x", True), lambda s: s.search_code("x", mode="bad"), lambda s: s.get_related("x", "up"), lambda s: s.get_related("x", depth=2)])
def test_bad_arguments(service, call):
    with pytest.raises(QueryValidationError):
        call(service)


def test_tools(spark, root, built, tmp_path):
    tools = Tools(spark, embed.HashingEncoder())
    assert json.loads(tools.repository_summary(root))[0]["parsed_count"] == 4
    assert json.loads(tools.hybrid_search(root, "tidy"))
    assert json.loads(tools.find_symbols(root, "tidy", True))[0]["kind"] == "function"
    assert len(json.loads(tools.find_routes(root))) == 2
    assert json.loads(tools.get_related_code(root, "file:pkg/api.py", "outgoing", "imports, calls"))
    assert json.loads(tools.analyze_change_impact(root, "file:pkg/api.py"))["import_relationships"]
    both = json.loads(tools.find_existing_implementation(root, "tidy"))
    assert both["code_matches"] and both["symbol_matches"]
    assert json.loads(tools.search_code(str(tmp_path), "x"))["code"] == "RepositoryNotIndexedError"
    assert json.loads(tools.search_code("", "x"))["code"] == "QueryValidationError"


def test_rebuild_replaces_and_failures_leave_the_old(spark, tmp_path):
    root = make(tmp_path, TWINS)
    first = index.build(spark, root).generation
    assert {"inherits": 1, "tests": 2}.items() <= {r.relation: r["count"] for r in Store(spark, tmp_path / ".quarrylight").read("edges", first).groupBy("relation").count().collect()}.items()
    (tmp_path / "three.py").write_text("x = 1; x = 2\n")
    second = index.build(spark, root)
    assert second.generation != first and os.listdir(tmp_path / ".quarrylight/generations") == [second.generation]

    class Broken(embed.HashingEncoder):
        def encode(self, texts):
            raise RuntimeError("no")

    with pytest.raises(index.BuildError) as e:
        index.build(spark, root, encoder=Broken())
    assert e.value.code == "embedding_failed" and Store(spark, tmp_path / ".quarrylight").active() == second.generation
    store = Store(spark, tmp_path / ".quarrylight")
    with store.locked(), pytest.raises(index.BuildError):
        index.build(spark, root)
    (tmp_path / ".quarrylight/active.json").write_text('{"generation": "../x"}')
    with pytest.raises(StoreError):
        store.active()
    with pytest.raises(RepositoryNotIndexedError):
        QueryService(spark, root).find_routes()


def test_secrets_binaries_and_errors(spark, tmp_path):
    root = make(tmp_path, {"a.py": 'API_TOKEN = "ghp_abcdefghij0123456789"\n', "b.py": "def broken(:\n", "c.py": b"\xff\xfe\x00", "d.pyw": "x = 1\n", "e.exe": b"MZ", "f.py": "", "notes.txt": "words\n"})
    built = index.build(spark, root, stop_after="graphing")
    chunks = built.frames["chunks"].collect()
    assert not any("ghp_" in r.content for r in chunks) and any("[REDACTED]" in r.content for r in chunks)
    assert built.frames["encoded"].count() == 0 and built.counts["errors"] == 1
    codes = sorted(r.code for r in built.frames["diagnostics"].where("severity = 'warning'").collect())
    assert codes == ["file_secret_detected", "file_skipped", "file_skipped"]


def test_empty_repository(spark, tmp_path):
    built = index.build(spark, str(tmp_path))
    assert built.counts["files"] == 0 and QueryService(spark, str(tmp_path), embed.HashingEncoder()).search_code("x").count() == 0
    names = {r.name: r.ok for r in health.health(spark, str(tmp_path)).collect()}
    assert names["index"] and names["configuration"] and names["spark"]


def test_source_is_never_run(spark, tmp_path):
    root = make(tmp_path, {"trip.py": f'from pathlib import Path\nPath({str(tmp_path / "ran")!r}).touch()\n\n\ndef f():\n    pass\n'})
    built = index.build(spark, root, stop_after="graphing")
    assert (built.counts["parsed"], built.counts["chunks"], built.counts["nodes"], built.counts["edges"]) == (1, 2, 3, 2)
    assert not (tmp_path / "ran").exists()


def test_limits(spark, tmp_path):
    root = make(tmp_path, {"a.py": "x = 1\n", "b.py": "y = 1\n", ".quarrylight/config.json": '{"schema_version": 1, "max_files": 1}'})
    with pytest.raises(index.BuildError) as e:
        index.build(spark, root)
    assert e.value.code == "repository_limit_exceeded"


def test_impact_schema(spark):
    assert lookup.relations(["calls", "x"]) == ["calls"] and lookup.relations(["x"]) == list(schemas.RELATIONS)
    assert spark.range(1).select(schemas.in_domain("id", ("0",)) == F.lit(True)).first()[0]


def test_a_killed_build_leaves_no_lock(spark, tmp_path):
    store = Store(spark, tmp_path)
    code = f"import fcntl, os; fcntl.flock(os.open({str(tmp_path / 'build.lock')!r}, os.O_CREAT | os.O_WRONLY), fcntl.LOCK_EX); print(1, flush=True); input()"
    holder = subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    assert holder.stdout.readline()
    with pytest.raises(StoreError, match="running"), store.locked():
        pass
    holder.kill()
    holder.communicate()
    with store.locked(), pytest.raises(StoreError, match="running"), store.locked():
        pass
    with store.locked():
        pass


def test_any_failure_ends_the_build(spark, tmp_path, monkeypatch):
    root, made, real = make(tmp_path, TWINS), [], index.Build
    monkeypatch.setattr(index, "Build", lambda *a: made.append(real(*a)) or made[-1])

    def fails(*_, **__):
        raise RuntimeError("a job failed")

    monkeypatch.setattr(index.graph, "build", fails)
    with pytest.raises(RuntimeError, match="a job failed"):
        index.build(spark, root)
    assert made[0].state.state == "error" and Store(spark, tmp_path / ".quarrylight").active() is None


def test_archives_keep_their_index(spark, tmp_path, capsys):
    archive, home, said = tmp_path / "tree.zip", tmp_path / "home", []
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("top/one.py", "def one():\n    pass\n")
    run = lambda *a: cli.main([*a], make_session=lambda: spark, out=said.append)
    assert run("index", str(archive)) == 1 and "root_needed" in capsys.readouterr().err
    assert run("index", str(archive), "--root", str(home)) == 0 and json.loads(said[-1])["files"] == 1
    assert run("query", "find_symbols", str(home), "query=one") == 0 and json.loads(said[-1])[0]["qualified_name"] == "one"
