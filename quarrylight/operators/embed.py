"""Chunks to vectors, with an encoder that can be exchanged."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text, vectors

# Fixed values.
DIMENSION, BATCH, LONGEST_BYTES, LONGEST_LINES = 384, 100, 102_400, 100


class Encoder(Protocol):
    """What turns texts into vectors of `dimension` numbers; it is sent to executors."""

    name: str
    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class EncoderUnavailable(RuntimeError):
    """The encoder can't be loaded."""


class HashingEncoder:
    """Words hashed to signed coordinates, scaled to unit length; needs no model and is the same everywhere."""

    def __init__(self, dimension: int = DIMENSION):
        self.name, self.dimension = f"hashing-{dimension}", dimension

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for word in re.findall(r"[^\W_]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


def eligible(chunks: DataFrame) -> Column:
    """Chunks with content, from files without secrets that parsed."""
    return ~text.is_blank(F.coalesce(chunks["content"], F.lit(""))) & ~chunks["has_secrets"] & (chunks["parse_status"] != "error")


def prepared(content: Column) -> Column:
    """Content of more than 100 KiB is cut to its first 100 lines."""
    return F.when(F.octet_length(content) > LONGEST_BYTES, F.array_join(F.slice(text.lines(content), 1, LONGEST_LINES), "\n")).otherwise(content)


def encode(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """id, vector and error for every eligible chunk; a batch that fails gives its rows a null vector and the error."""

    def run(frames):
        for frame in frames:
            found: list = []
            for at in range(0, len(frame), BATCH):
                texts = frame["content"].iloc[at : at + BATCH].tolist()
                try:
                    got = encoder.encode(texts)
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                    found += [(v, None) for v in got]
                except Exception as e:  # noqa: BLE001  whatever an encoder raises concerns its batch only
                    found += [(None, f"{type(e).__name__}: {e}"[:500])] * len(texts)
            yield pd.DataFrame({"id": frame["id"], "vector": [v for v, _ in found], "error": [e for _, e in found]})

    wanted = chunks.where(eligible(chunks)).select("id", prepared(F.col("content")).alias("content"))
    raw = wanted.mapInPandas(run, "id string, vector array<float>, error string")
    good = vectors.is_valid(F.col("vector"), encoder.dimension)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~good, "invalid vector")
    return raw.select("id", F.when(error.isNull(), F.col("vector")).alias("vector"), error.alias("error"))


def embeddings(chunks: DataFrame, encoded: DataFrame) -> DataFrame:
    """The vectors with what searches show; nulls become empty strings."""
    df = encoded.where("vector is not null").join(chunks, "id")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select(F.col("id").alias("chunk_id"), "file_path", blank("symbol_name"), "chunk_type", blank("language"), "start_line", "end_line", "vector")


def counts(chunks: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row: total, eligible, embedded, failed, skipped."""
    a = chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(eligible(chunks)).alias("eligible"))
    b = encoded.agg(F.count("vector").alias("embedded"), F.count("error").alias("failed"))
    return a.crossJoin(b).withColumn("skipped", F.col("total") - F.col("eligible"))


def invalid_inputs(chunks: DataFrame) -> DataFrame:
    """code and id of chunks that an encoder must not get: no id, an id twice, no content, no type."""
    twice = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_chunk").alias("code"), "id")
    bad = F.when(F.col("id").isNull() | (F.col("id") == ""), "missing_id").when(F.col("content").isNull(), "missing_content").when(F.col("chunk_type").isNull(), "missing_type")
    return chunks.select(bad.alias("code"), "id").where("code is not null").unionByName(twice)
