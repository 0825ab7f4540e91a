"""Each rule has a row that breaks it and nothing else."""

import pytest

from quarrylight.operators import rules

HASH = "a" * 64
GOOD = {
    "files": dict(path="a.py", file_type="source", parse_status="pending", size_bytes=1, line_count=1, content_hash=HASH, is_binary=False, text="x"),
    "parsed": dict(path="a.py", status="parsed", error=None, symbols=["s"]),
    "symbols": dict(symbol_id="s", name="n", symbol_type="class", start_line=1, end_line=2, path="a.py"),
    "routes": dict(route_id="r", method="GET", path="a.py"),
    "chunks": dict(id="c", file_path="a.py", start_line=1, end_line=2, content="x", content_hash="2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", chunk_type="config"),
    "embeddings": dict(chunk_id="c", file_path="a.py", vector=[0.5, 0.5], width=2),
    "nodes": dict(node_id="n", id="gn", node_type="file", confidence="EXTRACTED", source_file="a.py"),
    "edges": dict(id="ge", source_node_id="n", target_node_id="n", relation="calls", confidence="INFERRED", source_file="", source_location="1"),
}
TYPES = {str: "string", int: "long", bool: "boolean", list: "array<string>", type(None): "string"}
BAD = {
    ("files", "no_path"): [dict(path="")],
    ("files", "bad_file_type"): [dict(file_type="other")],
    ("files", "bad_parse_status"): [dict(parse_status=None)],
    ("files", "bad_size"): [dict(size_bytes=0)],
    ("files", "bad_line_count"): [dict(line_count=-1)],
    ("files", "bad_content_hash"): [dict(content_hash="A" * 64)],
    ("files", "text_of_binary"): [dict(is_binary=True)],
    ("files", "repeated_path"): [{}, {}, {}],
    ("parsed", "unknown_file"): [dict(path="b.py")],
    ("parsed", "repeated_parse"): [{}, {}],
    ("parsed", "unsettled_status"): [dict(status="pending", symbols=[])],
    ("parsed", "error_without_reason"): [dict(status="error", symbols=[])],
    ("parsed", "symbols_without_parse"): [dict(status="not_applicable")],
    ("symbols", "no_symbol_id"): [dict(symbol_id=None)],
    ("symbols", "repeated_symbol_id"): [{}, dict(name="other")],
    ("symbols", "no_symbol_name"): [dict(name="")],
    ("symbols", "bad_symbol_type"): [dict(symbol_type="struct")],
    ("symbols", "bad_first_line"): [dict(start_line=0)],
    ("symbols", "bad_last_line"): [dict(end_line=0, start_line=1)],
    ("routes", "no_route_id"): [dict(route_id="")],
    ("routes", "repeated_route_id"): [{}, {}],
    ("routes", "bad_method"): [dict(method="get")],
    ("chunks", "no_chunk_id"): [dict(id="")],
    ("chunks", "repeated_chunk_id"): [{}, {}],
    ("chunks", "unknown_file"): [dict(file_path="b.py")],
    ("chunks", "bad_first_line"): [dict(start_line=0)],
    ("chunks", "bad_last_line"): [dict(end_line=0)],
    ("chunks", "blank_content"): [dict(content=" \n", content_hash="")],
    ("chunks", "bad_content_hash"): [dict(content_hash=HASH)],
    ("chunks", "bad_chunk_type"): [dict(chunk_type="page")],
    ("embeddings", "no_chunk_id"): [dict(chunk_id="")],
    ("embeddings", "repeated_chunk_id"): [{}, {}],
    ("embeddings", "unknown_chunk"): [dict(chunk_id="d")],
    ("embeddings", "bad_width"): [dict(vector=[1.0])],
    ("embeddings", "bad_number"): [dict(vector=[1.0, float("nan")]), dict(chunk_id="c2", vector=[None, 1.0])],
    ("nodes", "no_node_id"): [dict(node_id="")],
    ("nodes", "repeated_node_id"): [{}, dict(id="gn2")],
    ("nodes", "no_record_id"): [dict(id="")],
    ("nodes", "repeated_record_id"): [{}, dict(node_id="n2")],
    ("nodes", "bad_node_type"): [dict(node_type="variable")],
    ("nodes", "bad_confidence"): [dict(confidence="SURE")],
    ("edges", "no_record_id"): [dict(id=None)],
    ("edges", "repeated_record_id"): [{}, dict(source_location="2")],
    ("edges", "repeated_edge"): [{}, dict(id="ge2")],
    ("edges", "no_source"): [dict(source_node_id="")],
    ("edges", "no_target"): [dict(target_node_id="")],
    ("edges", "bad_relation"): [dict(relation="likes")],
    ("edges", "bad_confidence"): [dict(confidence="")],
    ("edges", "unknown_source"): [dict(source_node_id="m")],
    ("edges", "unknown_target"): [dict(target_node_id="m")],
}
for _artifact, _path in (("files", "path"), ("chunks", "file_path"), ("embeddings", "file_path"), ("nodes", "source_file"), ("edges", "source_file")):
    BAD |= {(_artifact, "absolute_path"): [{_path: "/a.py"}], (_artifact, "path_leaves_root"): [{_path: "x/../a.py"}], (_artifact, "backslash_in_path"): [{_path: "x\\a.py"}]}


def frame(spark, artifact, rows):
    kinds = {k: "array<double>" if k == "vector" else TYPES[type(v)] for k, v in GOOD[artifact].items()}
    full = [{**GOOD[artifact], "at": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in (*kinds, "at")) for r in full], ", ".join(f"{k} {v}" for k, v in (*kinds.items(), ("at", "long"))))


def test_every_rule_has_a_case():
    assert {(a, r.name) for a, rs in rules.RULES.items() for r in rs} == set(BAD)


@pytest.fixture(scope="module")
def good(spark):
    """One good row of each artifact; many tiny queries run faster in one partition."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield {a: frame(spark, a, [{}]) for a in GOOD}
    for k, v in before.items():
        spark.conf.set(k, v)


#: Columns that must not repeat from one case to the next.
OWN = {"files": ["path"], "parsed": ["path"], "symbols": ["symbol_id"], "routes": ["route_id"], "chunks": ["id"], "embeddings": ["chunk_id"], "nodes": ["node_id", "id"], "edges": ["id", "source_location"]}


@pytest.mark.parametrize("artifact", GOOD)
def test_rules(spark, good, artifact):
    """All cases of an artifact in one frame, with places of their own: each breaks its own rule only."""
    assert rules.violations(artifact, good, "at").collect() == []
    cases = [(name, rows) for (of, name), rows in BAD.items() if of == artifact]
    rows = [{**{c: f"{GOOD[artifact][c]}-{k}" for c in OWN[artifact]}, **r, "at": 100 * k + i} for k, (_, case) in enumerate(cases) for i, r in enumerate(case)]
    known = {"files": frame(spark, "files", [{}, *({"path": f"a.py-{k}"} for k in range(len(cases)))]), "chunks": frame(spark, "chunks", [{"id": f"c-{k}"} for k in range(len(cases))])}
    found = rules.violations(artifact, good | known | {artifact: frame(spark, artifact, rows)}, "at").collect()
    for k, (name, case) in enumerate(cases):
        mine = [r for r in found if r.place // 100 == k]
        extra = {"unknown_chunk"} if name == "bad_number" else {"unknown_file"} if artifact == "chunks" and "path" in name else set()
        assert {r.rule for r in mine} - extra == {name}, (name, mine)
        if "repeated" in name:
            assert [r.place for r in mine] == [100 * k + len(case) - 1]
        if name in ("absolute_path", "path_leaves_root"):
            assert all(r.file_path is None for r in mine)
        if name == "backslash_in_path":
            assert {r.file_path for r in mine} == {"x/a.py"}


def test_the_first_violation_leads(spark, good):
    rows = [{}, dict(id="d", start_line=0, end_line=0), dict(id="", start_line=0), {}]
    found = rules.violations("chunks", good | {"chunks": frame(spark, "chunks", rows)}, "at").unionByName(rules.counted("chunks", good["chunks"], 7))
    assert found.count() == 5
    row = rules.first(found).first()
    assert (row.rule, row.place, row.key) == ("bad_first_line", 1, "d")
    only = rules.as_diagnostics(rules.first(rules.counted("chunks", good["chunks"], 7))).first()
    assert (only.code, only.severity, only.file_path) == ("chunks_wrong_count", "error", None)
    assert rules.counted("chunks", good["chunks"], 1).collect() == []


def test_counters():
    assert rules.broken_counters({"files": 3, "parsed": 1, "not_applicable": 1, "errors": 1, "symbols": 2, "routes": 1}) == []
    assert rules.broken_counters({"files": 3, "parsed": 1, "not_applicable": 1, "errors": 0}) == ["files are not the parsed, not applicable and failed ones"]
    assert rules.broken_counters({"symbols": 1, "routes": 2, "nodes": 0, "edges": 3}) == ["more routes than symbols", "edges without nodes"]
    assert rules.broken_counters({"files": -1, "chunks": True}) == ["chunks is not a count", "files is not a count"]
