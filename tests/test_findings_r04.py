"""Cases of the fourth round's findings, each of which failed before."""

from pyspark.sql import functions as F

from quarrylight import queries
from quarrylight.functions import bits
from quarrylight.operators import graph, parse


def test_only_rows_with_a_partner_move(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    rows = spark.range(5000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("k"), F.lit(1).alias("n")).unionByName(keys)
    found = [tuple(r) for r in bits.may_match(rows, keys, "k", "n").collect()]
    assert {("a", 1), ("b", 2), (None, 3)} <= set(found) and len(found) < 20
    assert bits.may_match(rows, keys.where("n > 3"), "k").count() == 0


def test_graph_of_sources_groups_no_symbols(spark):
    # Before, all symbols were shuffled by file, by id and by name, and all edges by their five columns.
    plan = queries.QUERIES["graph_of_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" not in plan and "relation#" in plan and plan.count("Aggregate [source_node_id") == 1


def test_edges_of_repeated_names(spark):
    files = [
        ("q.py", "class A(B, B): pass\nclass B:\n    def run(self): pass\nclass B: pass\n@app.get('/x')\n@app.get('/x')\ndef test_run(): run(); run(); A()\nimport os, os\n", False, "pending", "source"),
        ("test_q.py", "@app.get('/t')\ndef go(): go()\nclass C:\n    def run(self): test_run()\ndef test_B(): pass\n", False, "pending", "test"),
    ]
    scanned = spark.createDataFrame(files, "path string, text string, is_binary boolean, parse_status string, file_type string")
    plain = graph.build(scanned.select("path", "file_type"), parse.parse(scanned))[1].collect()
    short = sorted((r.relation, r.source_node_id.split(":", 1)[1], r.target_node_id.split(":", 1)[1]) for r in plain if r.relation in ("inherits", "calls", "tests"))
    assert short == [
        ("calls", "q.py:test_run:7", "q.py:run:3"),
        ("calls", "q.py:test_run:7", "test_q.py:run:4"),
        ("calls", "test_q.py:run:4", "q.py:test_run:7"),
        ("inherits", "q.py:A:1", "q.py:B:2"),
        ("inherits", "q.py:A:1", "q.py:B:4"),
        ("tests", "q.py:test_run:7", "q.py:run:3"),
        ("tests", "q.py:test_run:7", "test_q.py:run:4"),
        ("tests", "test_q.py:test_B:5", "q.py:B:2"),
        ("tests", "test_q.py:test_B:5", "q.py:B:4"),
    ]
    rows = parse.items(parse.parse(scanned, "file_type"))
    symbols = rows.where("symbols is not null").select("path", "file_type", "symbols.*")
    again = graph.edges(scanned, symbols, rows.where("imports is not null").select("path", "imports.*"), rows.where("routes is not null").select("path", "routes.*"))
    assert sorted(map(str, again.collect())) == sorted(map(str, plain)) and len({r.id for r in plain}) == len(plain)


def test_shared_names_are_joined_by_groups_and_blocks(spark, monkeypatch):
    # Before, all rows of a name came from one task, and each source met all its targets in turn.
    monkeypatch.setattr(graph, "BLOCK", 4)
    monkeypatch.setattr(graph, "SLOT", 8)
    sources = spark.createDataFrame([("x", "often", 1), ("x", "often", 1), (None, "often", 3), ("z", None, 4), ("y", "once", 5), ("w", "none", 6)] + [(f"s{i}", "often", i) for i in range(30)], "source_id string, name string, n int")
    rows = [(f"t{i}", "often", "function") for i in range(21)] + [("t1", "often", "class"), (None, "often", "class"), ("u", "once", "class"), ("v", None, "class"), ("q", "often", "variable")] + [(f"n{i}", "alone", "class") for i in range(9)]
    targets = spark.createDataFrame(rows, "node_id string, name string, symbol_type string")
    plain = graph.by_name(sources, "name", targets, ("function", "class"))
    found = graph.by_name(sources, "name", targets, ("function", "class"), shared=True)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() == 33 * 23 + 1
    often = [(r.source_id, r.target_id, r.task) for r in found.where("name = 'often'").withColumn("task", F.spark_partition_id()).collect()]
    assert len({task for *_, task in often}) > 1
    turns = sum(a[0] != b[0] for a, b in zip(often, often[1:], strict=False))
    assert turns > 33 * 3  # sources change by block
