"""Approximate nearest vectors: inverted lists with product-quantised residuals, and exact scores for what they find.

Fitting takes a bounded sample (SAMPLE rows, by smallest hash of the key, so that it is the same each time): k-means gives LISTS coarse
centres, and k-means of the residuals in each of PARTS stretches of the vector gives CODES code words. Every row is then indexed: its
list, and one code for each stretch. A search scans the lists whose centres are nearest to the query, sums table look-ups for
each row, keeps the best by that estimate, and takes exact cosine scores of these from the vectors. With all lists probed and
everything re-ranked the result is the exact one.

The index is a merge-on-read table: parts are written once; an upsert or delete adds a part (rows, or tombstones) with a higher number, the
latest entry of a key counts, and compaction writes one part of what counts. `state.json` names the parts that count and is replaced in one
step, so that readers see each change whole.

Vectors are taken as directions: cosine similarity. Null, empty and zero vectors, and those of another width than most, are kept with list
null; only an exact search (a query of that width, or without a model) finds them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import vectors
from quarrylight.sources.hadoop import Files

#: Rows that centres and code words are fitted on, at most; a bound of the driver's memory.
SAMPLE = 20_000
LISTS, PARTS, CODES, ROUNDS = 64, 16, 64, 12


def _kmeans(points: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from centres drawn among the points; centres without points are drawn anew."""
    k = max(1, min(k, len(points)))
    centres = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        alive = n > 0
        centres[alive] = sums[alive] / n[alive, None]
        if not alive.all():
            centres[~alive] = points[draw.choice(len(points), int((~alive).sum()))]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


@dataclass(frozen=True)
class Model:
    """Coarse centres (lists x width) and code words (parts x codes x stretch)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _units(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of that width and some length, and these as unit vectors."""
    rows = array.to_pylist()
    good = np.array([x is not None and len(x) == width and all(v is not None for v in x) and any(x) for x in rows], dtype=bool)
    found = np.array([rows[i] for i in np.flatnonzero(good)], dtype=np.float64).reshape(-1, width)
    norms = np.linalg.norm(found, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    good[np.flatnonzero(good)[~fine]] = False
    return good, found[fine] / norms[fine, None]


def fit(table: DataFrame, *, key: str, vector: str, lists: int = LISTS, parts: int = PARTS, codes: int = CODES, sample: int = SAMPLE, seed: int = 1) -> Model | None:
    """The model of a table; None where it has no vector of some length. `parts` is lowered to a divisor of the width."""
    some = table.where(F.size(vector) > 0).select(F.col(vector).alias("v"), F.xxhash64(F.col(key).cast("string")).alias("h")).orderBy("h").limit(sample)
    found = some.select("v").toArrow().column(0).combine_chunks()
    widths = [len(x) for x in found.to_pylist() if x]
    if not widths:
        return None
    width = max(set(widths), key=widths.count)
    _, points = _units(found, width)
    if not len(points):
        return None
    parts = next(p for p in range(min(parts, width), 0, -1) if width % p == 0)
    draw = np.random.default_rng(seed)
    centres = _kmeans(points, lists, draw)
    rest = (points - centres[_nearest(points, centres)]).reshape(len(points), parts, width // parts)
    words = [_kmeans(rest[:, p], codes, draw) for p in range(parts)]
    most = max(map(len, words))
    return Model(centres, np.stack([np.concatenate([w, np.repeat(w[:1], most - len(w), 0)]) for w in words]))


def encode(table: DataFrame, model: Model, *, key: str, vector: str) -> DataFrame:
    """key, vector, list (null without a usable vector) and code (a byte for each stretch)."""
    shared = table.sparkSession.sparkContext.broadcast((model.centres, model.words))  # of fixed size

    def run(batches):
        centres, words = shared.value
        parts, _, stretch = words.shape
        for batch in batches:
            good, points = _units(batch.column(1), centres.shape[1])
            lists, codes = np.zeros(len(good), dtype=np.int32), [None] * len(good)
            if len(points):
                near = _nearest(points, centres)
                rest = (points - centres[near]).reshape(len(points), parts, stretch)
                found = np.stack([_nearest(rest[:, p], words[p]) for p in range(parts)], axis=1).astype(np.uint8)
                lists[good] = near
                for i, code in zip(np.flatnonzero(good), found, strict=True):
                    codes[i] = code.tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lists, mask=~good), pa.array(codes, pa.binary())], ["key", "vector", "list", "code"])

    source = table.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, vector array<float>, list int, code binary")


class VectorIndex:
    """An index in a folder, on any file system that Spark knows. One writer at a time: hold the store's lease."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    def _state(self) -> dict:
        return json.loads(self.files.read(self.files.at("state.json")))

    def model(self) -> Model | None:
        said = json.loads(self.files.read(self.files.at("model.json")))
        return None if said is None else Model(np.array(said["centres"]), np.array(said["words"]))

    @classmethod
    def build(cls, table: DataFrame, folder: str, *, key: str = "chunk_id", vector: str = "vector", **sizes) -> VectorIndex:
        """A new index of all rows; keys must not repeat."""
        out, model = cls(table.sparkSession, folder), fit(table, key=key, vector=vector, **sizes)
        out.files.create(out.files.at("model.json"), json.dumps(model and {"centres": model.centres.tolist(), "words": model.words.tolist()}))
        out._commit(out._encoded(table, key, vector, model), [], 0)
        return out

    def _encoded(self, table: DataFrame, key: str, vector: str, model: Model | None) -> DataFrame:
        if model is None:
            return table.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code"))
        return encode(table, model, key=key, vector=vector)

    def _commit(self, rows: DataFrame, kept: list, number: int, *, gone: bool = False) -> None:
        name = f"part-{uuid.uuid4().hex}"
        rows = rows.withColumns({"number": F.lit(number).cast("long"), "gone": F.lit(gone)})
        rows.repartitionByRange(F.coalesce("list", F.lit(-1)), "key").sortWithinPartitions("list", "key").write.parquet(self.files.at(name))  # a search's lists are few row groups
        self.files.replace(self.files.at("state.json"), json.dumps({"parts": [*kept, name], "number": number}))

    def upsert(self, table: DataFrame, *, key: str = "chunk_id", vector: str = "vector") -> None:
        """Adds rows, or puts them in the place of those of the same key; of a key given twice the greater vector counts."""
        state = self._state()
        one = table.select(F.col(key).alias("key"), F.col(vector).alias("vector")).groupBy("key").agg(F.max("vector").alias("vector"))
        self._commit(self._encoded(one, "key", "vector", self.model()), state["parts"], state["number"] + 1)

    def delete(self, keys: DataFrame, *, key: str = "chunk_id") -> None:
        """Takes rows out; keys that aren't there do nothing."""
        state = self._state()
        marks = keys.select(F.col(key).alias("key"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code")).distinct()
        self._commit(marks, state["parts"], state["number"] + 1, gone=True)

    def rows(self) -> DataFrame:
        """key, vector, list and code of what counts."""
        state = self._state()
        whole = self.spark.read.parquet(*(self.files.at(p) for p in state["parts"]))
        if len(state["parts"]) > 1:
            latest = whole.groupBy("key").agg(F.max("number").alias("number"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")  # only keys that changed
            changed = whole.join(latest.select("key", F.col("number").alias("latest")), "key", "left")
            whole = changed.where("latest is null or number = latest").drop("latest")
        return whole.where("not gone").select("key", "vector", "list", "code")

    def compact(self) -> None:
        """One part of what counts; the others go once nothing names them."""
        state = self._state()
        self._commit(self.rows(), [], state["number"] + 1)
        for part in state["parts"]:
            self.files.delete(self.files.at(part))

    def search(self, query: list[float], k: int, *, probes: int = 16, ranked: int = 20) -> DataFrame:
        """The k nearest: key and score (exact, between 0 and 1), ties in order of the key.

        `probes` lists are scanned, and `ranked` times k rows of best estimate get exact scores.
        """
        model, rows = self.model(), self.rows()
        exact = lambda df: df.select("key", vectors.clamped(vectors.cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query)))).alias("score")).orderBy(F.desc("score"), "key").limit(k)
        q = np.array(query, dtype=np.float64)
        norm = np.linalg.norm(q) if len(q) else 0.0
        if model is None or len(q) != model.width or not np.isfinite(norm) or norm == 0:
            return exact(rows)
        products = model.centres @ (q / norm)
        lists = np.argsort(-products, kind="stable")[:probes].tolist()
        near = rows.where(F.col("list").isin(lists))
        tables = np.einsum("pcs,ps->pc", model.words, (q / norm).reshape(model.words.shape[0], -1))
        best = near.withColumn("estimate", self._estimate(products, tables)).orderBy(F.desc("estimate"), "key").limit(ranked * k)
        return exact(best)

    @staticmethod
    def _estimate(products: np.ndarray, tables: np.ndarray) -> Column:
        """The product of a row with the query as its list and codes have it, by look-ups in literals of fixed size."""
        literal = lambda xs: F.from_json(F.lit(json.dumps([round(float(x), 9) for x in xs])), "array<double>")
        hexes = F.hex("code")
        parts = [F.get(literal(t), F.conv(F.substring(hexes, 2 * p + 1, 2), 16, 10).cast("int")) for p, t in enumerate(tables)]
        return F.get(literal(products), F.col("list")) + sum(parts[1:], parts[0])
