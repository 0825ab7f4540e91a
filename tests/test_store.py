"""The store on Hadoop paths: leases, fenced commits, migration, logs, and the stored full-text index."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.operators import fulltext, inverted
from quarrylight.plans import store as stores
from quarrylight.plans.log import Log
from quarrylight.plans.store import Store, StoreError
from quarrylight.sources.hadoop import Files

GENERATION = "generation-" + "0" * 23


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_files(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.create(files.at("a"), "one") and not files.create(files.at("a"), "two") and files.read(files.at("a")) == "one"
    files.replace(files.at("a"), "thrée")
    assert files.read(files.at("a")) == "thrée" and files.names(files.root) == ["a"] and files.names(files.at("none")) == []
    assert files.move(files.at("a"), files.at("b")) and not files.exists(files.at("a"))
    with pytest.raises(FileNotFoundError):
        files.read(files.at("a"))


def test_one_of_two_builds_gets_the_lease(store, spark):
    won, lost = [], []

    def build() -> None:
        other = Store(spark, store.files.root)
        try:
            with other.locked():
                won.append(other.epoch)
                done.wait(20)
        except StoreError as e:
            lost.append(e.code)
            done.set()

    done = threading.Event()
    both = [threading.Thread(target=build) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert won == [1] and lost == ["locked"]
    with store.locked():
        assert store.epoch == 2


def test_a_silent_build_loses_its_lease_and_commits_nothing(spark, store, monkeypatch):
    """The first build stops giving signs; a second takes over; the first comes back and must not replace what the second made."""
    monkeypatch.setattr(stores.Store, "_system_lock", lambda self: __import__("contextlib").nullcontext())  # as on a file system without locks
    late = Store(spark, store.files.root)
    with late.locked():
        with pytest.raises(StoreError, match="running"), store.locked():
            pass
        monkeypatch.setattr(stores, "SILENT", -1.0)
        with store.locked():
            assert store.epoch == late.epoch + 1
            store.files.make(store.files.at("generations", GENERATION + "2"))
            monkeypatch.setattr(stores.Store, "violations", lambda self, name: spark.createDataFrame([], "code string, key string"))
            store.promote(GENERATION + "2")
            late.files.make(late.files.at("generations", GENERATION + "1"))
            with pytest.raises(StoreError) as e:
                late.promote(GENERATION + "1")
            assert e.value.code == "lease_lost"
            # Even a pointer that the first wrote after all changes nothing.
            late.files.replace(late.files.at(stores.POINTER), json.dumps({"generation": GENERATION + "1", "epoch": late.epoch}))
            assert store.active() == GENERATION + "2"
            with pytest.raises(StoreError):
                late.remove_others()
    assert store.files.names(store.files.at("leases")) == ["free-2"] or store.active() == GENERATION + "2"


def test_a_dead_process_of_this_machine_holds_nothing(spark, store, monkeypatch):
    store.files.make(store.files.at("leases"))
    store.files.create(store.files.at("leases", "7"), json.dumps({"host": stores.socket.gethostname(), "pid": 1 << 30}))
    with store.locked():
        assert store.epoch == 8


def rows_of(spark, schema, **values):
    defaults = {"string": "x", "int": 1, "bigint": 1, "boolean": False, "timestamp": None, "array<float>": [1.0]}
    return spark.createDataFrame([tuple(values.get(f.name, defaults[f.dataType.simpleString()]) for f in schema)], schema)


def test_a_generation_of_version_1_is_read(spark, store):
    name = GENERATION + "a"
    old = [f.name for f in schemas.STATUS][:7]
    for table, schema in schemas.TABLES.items():
        frame = spark.createDataFrame([], schema)
        if table == "index_status":
            frame = rows_of(spark, schema, repo_id="r", status="complete").select(*old)
        if table == "files":
            frame = rows_of(spark, schema, parse_status="parsed").unionByName(rows_of(spark, schema, parse_status="error"))
        if table == "nodes":
            frame = rows_of(spark, schema, node_type="import")
        frame.write.parquet(store.files.at("generations", name, table))
    store.files.create(store.files.at("generations", name, stores.MANIFEST), json.dumps({"schema_version": 1}))
    row = store.read("index_status", name).first()
    assert (row.repo_id, row.files, row.parsed, row.errors, row.nodes, row.imports, row.edges, row.fatal_errors) == ("r", 2, 1, 1, 1, 1, 0, 0)
    assert store.read("files", name).schema == schemas.FILES or store.read("files", name).columns == schemas.FILES.names
    assert store.index("chunks", name) is None
    for version in (0, schemas.SCHEMA_VERSION + 1):
        store.files.replace(store.files.at("generations", name, stores.MANIFEST), json.dumps({"schema_version": version}))
        with pytest.raises(StoreError) as e:
            store.read("files", name)
        assert e.value.code == "schema_version"


def test_log_of_many_writers(spark, tmp_path):
    folder = str(tmp_path / "log")
    logs = [Log(spark, folder, schemas.TOOL_CALLS) for _ in range(4)]
    threads = [threading.Thread(target=lambda log=log, k=k: [log.append(tool_name=f"t{k}", result_count=i) for i in range(10)]) for k, log in enumerate(logs)]
    for t in threads:
        t.start()
    for t in threads[:2]:
        t.join()
    packed = logs[0].pack()
    for t in threads[2:]:
        t.join()
    want = sorted((f"t{k}", i) for k in range(4) for i in range(10))
    found = lambda: sorted((r.tool_name, r.result_count) for r in logs[1].read().collect())
    assert packed >= 20 and found() == want
    logs[2].pack()
    assert found() == want and logs[2].pack() == 0 and logs[2]._paths(set()) == []
    logs[0].files.create(logs[0].files.at("packing"), "")  # another session is packing
    logs[0].append(tool_name="t9", result_count=1)
    assert logs[1].pack() == 0 and len(found()) == 41


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    words = ["the", "of", "and", "Über", "naïve", "the", "snake_case", "x1", "café"]
    rows = [(f"k{draw.randrange(10**6):06}", " ".join(draw.choices(words, k=draw.randrange(0, 40))), draw.choice(words)) for _ in range(200)]
    return spark.createDataFrame([*rows, ("k-empty", "", ""), ("k-null", None, None), ("k-long", "the " * 5000, "of")], "id string, content string, name string")


@pytest.fixture(scope="module")
def text_index(spark, texts, tmp_path_factory):
    return inverted.build(texts, ("content", "name"), str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("query", ["the", "the of", "uber OR x1", "the NOT of", '"of the"', '"the the the"', "snake_case", "caf*", "name:cafe", 'name:of "and of"', '"the snak"*', '""', "the NOT absent", "absent"])
def test_index_ranks_like_a_scan(texts, text_index, query):
    want = {r.id: round(r.rank, 9) for r in fulltext.match(texts, ("content", "name"), query).collect()}
    keys = {r.number: r.key for r in text_index.table("documents").collect()}
    assert {keys[r.number]: round(r.rank, 9) for r in inverted.match(text_index, query).collect()} == want
    top = [(r.id, round(r.rank, 9)) for r in inverted.search(text_index, query, 7).collect()]
    assert top == [(r.id, round(r.rank, 9)) for r in fulltext.search(texts, ("content", "name"), query, 7).collect()]


def test_index_blocks_counts_and_orphans(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    index = inverted.build(texts, ("content", "name"), str(tmp_path / "i"), buckets=3)
    assert index.table("postings").agg(F.max(F.size("entries"))).first()[0] <= 16
    assert inverted.match(index, "the").count() == fulltext.match(texts, ("content", "name"), "the").count()
    gone = inverted.orphans(index, texts.where("id <> 'k-long'").unionByName(spark.createDataFrame([("k-new", "a", "b")], texts.schema)))
    assert sorted(map(tuple, gone.collect())) == [("posting_without_row", "k-long"), ("row_without_posting", "k-new")]
    counts = {r.column_name: (r.documents, r.words) for r in inverted.row_counts(index).collect()}
    n = texts.select(*(F.struct(F.count_if(F.size(fulltext.tokens(F.col(c))) > 0), F.sum(F.size(fulltext.tokens(F.col(c))))).alias(c) for c in ("content", "name"))).first()
    assert counts == {c: tuple(n[c]) for c in ("content", "name")}
    with pytest.raises(fulltext.QuerySyntaxError):
        inverted.match(index, "f(")
    empty = inverted.build(texts.limit(0), ("content", "name"), str(tmp_path / "e"))
    assert inverted.search(empty, "the of*", 5).collect() == [] and os.path.isdir(tmp_path / "e/postings")
