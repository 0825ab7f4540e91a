"""Cases of the third round's findings, each of which failed before."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight import queries
from quarrylight.operators import graph, inverted, parse, paths


def test_ranks_equal_to_six_places_are_ordered_by_key(spark, tmp_path):
    # A word that most rows hold weighs next to nothing: ranks differ, but not in six places.
    docs = spark.createDataFrame([(1, "the y"), (2, "the"), (3, "the " + "x " * 40), (4, "z")], "id long, text string")
    index = inverted.build(docs, ("text",), str(tmp_path / "index"))
    assert [r["id"] for r in inverted.search(index, "the", 2).collect()] == [2, 1]
    assert [tuple(r) for r in inverted.search(index, "the", 2, decimals=6).collect()] == [(1, -2e-06), (2, -2e-06)]


def test_postings_are_shuffled_once_by_bucket(spark, tmp_path, monkeypatch):
    # Before, positions were grouped twice and then ranged: three shuffles of them.
    monkeypatch.setattr(inverted, "BLOCK", 4)
    docs = spark.createDataFrame([(i, f"the w{i} the") for i in range(11)], "id long, text string").repartition(3)
    index = inverted.build(docs, ("text",), str(tmp_path / "index"), buckets=2)
    rows = index.table("postings").where("term = 'the'").select("block", F.inline("entries")).orderBy("block", "offset").collect()
    assert [(r.block * 4 + r.offset, r.doc_len, r["at"]) for r in rows] == [(i, 3, [0, 2]) for i in range(11)]
    moved = []
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *names, _was=DataFrame.groupBy: (moved.append(names), _was(self, *names))[1])
    inverted.build(docs, ("text",), str(tmp_path / "again"), buckets=2)
    assert ("term", "column", "block", "offset", "doc_len") not in moved and ("term", "column", "block") not in moved


def test_links_are_made_once_for_all_hops(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    steps = spark.createDataFrame([("a", "b", "calls", "EXTRACTED"), ("b", "c", "calls", "EXTRACTED"), ("c", "d", "calls", "EXTRACTED")], "a string, b string, relation string, confidence string")
    found = paths.reach(steps.mapInArrow(counted, steps.schema), spark.createDataFrame([("a",)], "node_id string"), 3)
    assert {r.node_id: (r.hops, r.path) for r in found.collect()} == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"]), "d": (3, ["a", "b", "c", "d"])}
    assert made.value == 3


def test_flat_symbols_are_those_of_the_lists(spark):
    files = [("a.py", "class A:\n    def f(self): return g()\n@app.get('/x')\ndef h(): pass\n", False, "pending"), ("b.py", "def (", False, "pending"), ("c.py", "x = 1; x = 2", False, "pending"), ("d.py", "y = 1", False, "done")]
    scanned = spark.createDataFrame(files, "path string, text string, is_binary boolean, parse_status string")
    flat, lists = parse.parse_symbols(scanned), parse.symbols(parse.parse(scanned))
    assert flat.columns == lists.columns and sorted(map(str, flat.collect())) == sorted(map(str, lists.collect())) and flat.count() == 6


def test_walks_of_statements_leave_expressions_alone(monkeypatch):
    # Before, every node of every expression was visited three times.
    tree = parse.ast.parse("class A:\n    def f(self):\n        if x(1 + 2 * 3):\n            return [y for y in z]\n")
    assert [type(n).__name__ for n in parse.statements(tree)] == ["Module", "ClassDef", "FunctionDef", "If", "Return"]


def test_graph_of_sources_keeps_no_plan_of_the_sources(spark):
    # Before, the cached table carried the plan of the sources into every join and into all that the driver keeps of it.
    plan = queries.QUERIES["graph_of_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "InMemoryTableScan" not in plan and "MapInArrow" not in plan


def test_sources_of_one_file_are_joined_by_name_in_many_tasks(spark):
    sources = spark.createDataFrame([(i, "same") for i in range(40)], "id long, name string").coalesce(1)
    targets = spark.createDataFrame([("t", "same", "function")], "node_id string, name string, symbol_type string")
    found = graph.by_name(sources, "name", F.broadcast(targets), ("function",)).select("id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.id for r in found) == list(range(40)) and len({r.task for r in found}) > 1
