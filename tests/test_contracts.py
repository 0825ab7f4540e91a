"""The further tools over a small repository, and the logs of builds and calls."""

import json

import pytest

from quarrylight.operators import embed
from quarrylight.plans import index
from quarrylight.plans.service import QueryService
from quarrylight.plans.store import Store
from quarrylight.plans.tools import Tools
from tests.fixtures import SERVICE, make

MORE = {"tests/test_tools.py": "from tools import tidy\n\n\ndef test_tidy():\n    assert tidy(' x ') == 'x'\n"}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    out = make(tmp_path_factory.mktemp("contracts"), SERVICE | MORE)
    index.build(spark, out)
    return out


@pytest.fixture(scope="module")
def ask(spark, root):
    tools = Tools(spark, embed.HashingEncoder())
    return lambda tool, **arguments: json.loads(getattr(tools, tool)(root, **arguments))


def test_find_symbol(ask):
    found = ask("find_symbol", name="tidy")
    (one,) = found["results"]
    assert found["total_results"] == 1 and one["file_path"] == "pkg/tools.py" and one["signature"] == "(name)"
    assert one["called_by"] == ["hello", "load", "make_user", "test_tidy"]
    assert ask("find_symbol", name="load")["results"][0]["calls"] == ["tidy"]
    assert ask("find_symbol", name="tidy", symbol_type="class")["results"] == ask("find_symbol", name="nothing")["results"] == []


def test_file_context(ask):
    found = ask("get_file_context", file_path="pkg/api.py")
    assert [x["name"] for x in found["symbols"]][:3] == ["app", "Greeter", "hello"] and found["line_count"] == 23
    assert {x["module_name"] for x in found["imports"]} == {"fastapi", "tools"} and len(found["routes"]) == 2
    assert "pkg/tools.py" in found["related_files"] and "pkg/api.py" not in found["related_files"]
    assert ask("get_file_context", file_path="none.py")["error"] == "file_not_found"


def test_related_files_and_tests(ask):
    near = ask("find_related_files", target="pkg/tools.py", max_hops=1)
    assert {r["file_path"] for r in near["related_files"]} == {"pkg/api.py", "tests/test_tools.py"} and near["total_related"] == 2
    assert {r["hop_count"] for r in near["related_files"]} == {1}
    assert ask("find_related_files", target="pkg/tools.py", relation_types="tests")["related_files"] == [{"file_path": "tests/test_tools.py", "relation": "tests", "confidence": "INFERRED", "hop_count": 1}]
    assert ask("find_related_files", target="none.py")["related_files"] == [] and ask("find_related_files", target="x", max_hops=4)["code"] == "QueryValidationError"
    tests = ask("find_related_tests", target="tidy")
    assert tests["related_tests"] == [{"file_path": "tests/test_tools.py", "test_functions": [{"name": "test_tidy", "line": 4}], "relation": "tests", "confidence": "INFERRED"}]
    assert ask("find_related_tests", target="pkg/tools.py")["total_test_functions"] == 1


def test_change_impact(ask):
    found = ask("explain_change_impact", target="pkg/tools.py", function_name="tidy")["impact"]
    assert {x["function"] for x in found["direct_callers"]} == {"load", "hello", "make_user"} and found["risk_level"] == "medium"
    assert {x["function"] for x in found["indirect_callers"]} == {"get_user"} and [x["function"] for x in found["affected_tests"]] == ["test_tidy"]
    assert ask("explain_change_impact", target="none.py")["impact"] is None


def test_existing_implementation(ask):
    found = ask("check_existing_implementation", feature="tidy")
    assert found["existing"] and found["matches"][0]["symbol_name"] == "tidy" and found["matches"][0]["match_reason"] == "exact symbol name"
    assert found["matches"][0]["reuse_suggestion"] == "from pkg.tools import tidy"
    assert not ask("check_existing_implementation", feature="quantum entanglement")["existing"]


def test_logs(spark, root, ask):
    ask("find_symbol", name="tidy")
    ask("find_related_files", target="x", max_hops=9)
    store = Store(spark, f"file://{root}/.quarrylight")
    calls = {(r.tool_name, r.status) for r in store.tool_calls().read().collect()}
    assert {("find_symbol", "ok"), ("find_related_files", "error")} <= calls
    with pytest.raises(ValueError):
        index.build(spark, root, stop_after="nothing")

    class Broken(embed.HashingEncoder):
        def encode(self, texts):
            raise RuntimeError("no")

    with pytest.raises(index.BuildError):
        index.build(spark, root, encoder=Broken())
    rows = QueryService(spark, root).builds().collect()
    assert [(r.status, r.stage) for r in rows] == [("error", "embedding"), ("complete", "complete")]
    assert rows[0].error_code == "embedding_failed" and rows[0].completed_at >= rows[0].started_at
    assert QueryService(spark, root).search_symbols("tidy").first().rank is not None
