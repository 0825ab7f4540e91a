"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each piece of a text is merged by the tree in bpe.Bpe.encode_piece: its root is the leftmost pair of
lowest rank, and a merge updates three leaves in logarithmic time, so that a piece of
any length takes n log n steps. The ids of pieces are remembered in each worker (bpe.MEMO at most).

Defined results: a null or empty text has no ids and decodes to the empty text; rows are handled
one by one, so nulls in the id, repeated rows and ties give one result row each; other columns are
not read by encode_digests and are carried along by encoded, which replaces columns
called n_tokens, ids or decoded; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylight.llm import bpe
from quarrylight.llm.runtime import col


def encode_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 for each row."""
    path = vocabulary or bpe.default_path()

    def run(batches):
        model = bpe.load(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for x in batch.column(1).to_pylist():
                packed = model.encode_packed(x or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(model.decode(struct.unpack(f"<{n[-1]}I", packed)).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    fields = [source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return source.mapInArrow(run, T.StructType(fields))


def encoded(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """The rows with n_tokens and ids (array of int), and the text decoded from them if asked for."""
    path = vocabulary or bpe.default_path()
    new = ["n_tokens", "ids", *["decoded"] * decode]
    kept = [c for c in docs.columns if c.lower() not in new or c == text_col]
    at = kept.index(text_col)

    def run(batches):
        model = bpe.load(path)
        for batch in batches:
            ids = [model.encode(x or "") for x in batch.column(at).to_pylist()]
            out = [*batch.columns, pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
            if decode:
                out.append(pa.array([model.decode(x) for x in ids], pa.string()))
            yield pa.record_batch(out, [*kept, *new])

    source = docs.select(*map(col, kept))
    more = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return source.mapInArrow(run, T.StructType([*source.schema.fields, *(T.StructField(k, more[k]) for k in new)]))


def decoded(encodings: DataFrame, *, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with `decoded`: the text of their ids, special tokens included; null ids give the empty text."""
    path = vocabulary or bpe.default_path()
    kept = [c for c in encodings.columns if c.lower() != "decoded"]
    at = kept.index(ids_col)

    def run(batches):
        model = bpe.load(path)
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([model.decode(x or ()) for x in batch.column(at).to_pylist()], pa.string())], [*kept, "decoded"])

    source = encodings.select(*map(col, kept))
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())]))
