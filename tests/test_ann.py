"""The vector index: recall against brute force, edits against a full rebuild."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import ann

SCHEMA = "chunk_id string, vector array<float>"


def clustered(n: int, width: int = 32, seed: int = 5) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, width))
    return (centres[draw.integers(40, size=n)] + 0.6 * draw.normal(size=(n, width))).astype(np.float32)


def exact(vectors: dict, query, k: int) -> list:
    q = np.array(query)
    score = lambda v: float(np.clip(np.dot(np.array(v, dtype=float), q) / (np.linalg.norm(v) * np.linalg.norm(q) or 1), 0, 1)) if v is not None and len(v) else 0.0
    return sorted(((key, score(v)) for key, v in vectors.items()), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.fixture(scope="module")
def points():
    return {f"c{i:05}": v.tolist() for i, v in enumerate(clustered(4000))}


def test_recall_at_50(spark, points, tmp_path):
    index = ann.VectorIndex.build(spark.createDataFrame(list(points.items()), SCHEMA), str(tmp_path / "v"), sample=1000)
    assert index.rows().where("list is null").count() == 0
    hits = total = 0
    for i in range(0, 4000, 400):
        q = points[f"c{i:05}"]
        found = index.search(q, 50).collect()
        want = exact(points, q, 50)
        assert found[0].key == f"c{i:05}" and abs(found[0].score - 1) < 1e-6
        by_key = dict(exact(points, q, 4000))
        assert all(abs(r.score - by_key[r.key]) < 1e-6 for r in found)  # scores are exact
        hits, total = hits + len({r.key for r in found} & {k for k, _ in want}), total + 50
    assert hits / total >= 0.95
    all_lists = index.search(points["c00007"], 50, probes=ann.LISTS, ranked=100)
    assert [r.key for r in all_lists.collect()] == [k for k, _ in exact(points, points["c00007"], 50)]


def test_edits_equal_a_rebuild(spark, tmp_path):
    draw, now = random.Random(1), {f"c{i}": v.tolist() for i, v in enumerate(clustered(120, 8))}
    index = ann.VectorIndex.build(spark.createDataFrame(list(now.items()), SCHEMA), str(tmp_path / "v"), lists=4, parts=4, codes=8)
    for step in range(4):
        gone = draw.sample(sorted(now), 10)
        index.delete(spark.createDataFrame([(k,) for k in [*gone, "never"]], "chunk_id string"))
        now = {k: v for k, v in now.items() if k not in gone}
        new = {k: [draw.gauss(0, 1) for _ in range(8)] for k in [*draw.sample(sorted(now), 10), *gone[:3], f"new{step}"]}
        new = {k: np.array(v, dtype=np.float32).tolist() for k, v in new.items()}
        index.upsert(spark.createDataFrame(list(new.items()), SCHEMA))
        now |= new
        if step == 2:
            index.compact()
            assert len(index._state()["parts"]) == 1
    assert {r.key: r.vector for r in index.rows().collect()} == now
    fresh = ann.encode(spark.createDataFrame(list(now.items()), SCHEMA), index.model(), key="chunk_id", vector="vector")
    assert sorted(index.rows().select("key", "list", F.hex("code")).collect()) == sorted(fresh.select("key", "list", F.hex("code")).collect())


def test_odd_vectors(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0]), ("e", [1.0, 1.0, 1.0]), ("f", [0.5, 0.5]), ("g", [0.5, 0.5])]
    index = ann.VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "v"))
    assert {r.key for r in index.rows().where("list is null").collect()} == {"b", "c", "d", "e"}
    assert [(r.key, round(r.score, 6)) for r in index.search([1.0, 1.0], 2).collect()] == [("f", 1.0), ("g", 1.0)]
    empty = ann.VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert empty.search([1.0, 1.0], 2).collect() == [] and empty.model() is None
    empty.upsert(spark.createDataFrame(rows[:1], SCHEMA))
    assert [r.key for r in empty.search([1.0, 0.0], 2).collect()] == ["a"]
