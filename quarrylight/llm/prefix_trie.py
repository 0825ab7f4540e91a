"""The trie of conversation prefixes by smallest-member ownership.

Each conversation is a path of turns; a node is a prefix that one or more conversations share. The smallest member of a node owns
it, so that a conversation owns a suffix of its path (or nothing). Windows along the paths give running keys and token
sums and with them the owned suffixes; then one group-by over prefixes sums the tokens of all occurrences minus
those of owned nodes, leaf flags and the starts of child nodes. No member list of a node is ever gathered: owners are partially
aggregated minima, since a window over the members of a node would bring the root's to one task.

A prefix is known by the XOR of 128-bit hashes of (depth, turn) over its turns, a turn by the SHA-256 of its role and text.
Turns are dealt by ranges of (conversation, turn), so that a conversation of any length spreads over tasks; what such
tasks need of earlier ones is one row each. The ids that end at a node are hashed in order from blocks of ids
that were joined in parallel.

Defined results: rows without a conversation id are left out; turns go by number, null first, equal numbers by the SHA-256 of
their role's length, role and text; a null role or text is empty; repeated rows are turns of their own; other columns are not
read, whatever they are called; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.runtime import col, cut, stored

#: Conversations whose first turns are shared: those of one block of so many ids, and turns shared at most, less one.
BLOCK, HEADS = 20, 4
#: Ids that are joined before the hash over a node's ids takes them.
JOINED = 4096
_KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, s (hash of role and text), w (words) and part, dealt by ranges of (conv, turn, s)."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    hashed = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.select(col(id_col).cast("long").alias("conv"), col(turn_col).cast("long").alias("turn"), hashed.alias("s"), words.alias("w")).where("conv is not null")
    # The number of a range is written down: it must not change when a lost task is run again.
    return stored(rows.repartitionByRange("conv", "turn", "s").withColumn("part", F.spark_partition_id()))


def _earlier(of_parts: DataFrame, *names: str) -> DataFrame:
    """For each conversation that goes on in a part (at most one a part): totals of the parts before, by sum or XOR."""
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: (F.bit_xor(n) if n.startswith("k") else F.sum(n)).over(before).alias(f"{n}_before")
    out = of_parts.select("conv", "part", *map(total, names))
    return F.broadcast(out.where(F.col(f"{names[0]}_before").isNotNull()))  # one row for each part at most


def rebuilt(conversations: DataFrame, **columns) -> DataFrame:
    """The conversations with shared heads: conv, depth (from 0), k1 and k2 (key of the prefix), w (words of the last turn), sum_w (of all turns so far), p1 and p2 (key of the prefix before).

    Conversation c has the first h turns of c - c % BLOCK, h being crc32(c) % HEADS, and its own after its first h.
    """
    rows = turns(conversations, **columns)
    sizes = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("part", "conv").orderBy(F.col("turn").asc_nulls_first(), "s")

    convs = sizes.groupBy("conv").agg(F.sum("n").alias("n")).withColumns({"h": F.crc32(F.col("conv").cast("string")) % HEADS, "base": F.col("conv") - F.col("conv") % BLOCK})
    first = rows.where(F.col("conv") % BLOCK == 0).withColumn("k", F.row_number().over(within)).where(F.col("k") < HEADS)  # of each part, then of all
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "s"))).where(F.col("k") < HEADS)
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("k", "s", "w"))).alias("head"))  # HEADS - 1 turns at most
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<k:int,s:binary,w:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(heads, "base", "left").select("conv", "n", "h", head.alias("head"))
    fold = lambda pick, n: F.aggregate(F.slice("head", F.lit(1), n), F.lit(0).cast("long"), pick)
    x1, x2 = lambda depth, s: F.xxhash64(F.lit(1), depth.cast("long"), s), lambda depth, s: F.xxhash64(F.lit(2), depth.cast("long"), s)
    whole = F.size("head")
    h1, h2, hw = (lambda n: fold(lambda k, x: k.bitwiseXOR(x1(x["k"], x["s"])), n)), (lambda n: fold(lambda k, x: k.bitwiseXOR(x2(x["k"], x["s"])), n)), (lambda n: fold(lambda w, x: w + x["w"], n))
    convs = cut(convs.select("conv", "h", "head", whole.alias("m"), h1(whole).alias("h1"), h2(whole).alias("h2"), hw(whole).alias("hw")))

    placed = rows.withColumn("k", F.row_number().over(within)).join(_earlier(sizes, "n"), ["conv", "part"], "left").withColumn("k", F.col("k") + F.coalesce("n_before", F.lit(0)))
    own = placed.join(convs.drop("head"), "conv").where("k > h").withColumn("depth", F.col("k") - F.col("h") + F.col("m"))
    own = cut(own.select("conv", "part", "depth", "w", "h1", "h2", "hw", x1(F.col("depth"), F.col("s")).alias("k1"), x2(F.col("depth"), F.col("s")).alias("k2")))
    so_far = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = _earlier(own.groupBy("conv", "part").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("w").alias("w")), "w", "k1", "k2")
    zero = F.lit(0).cast("long")
    run = lambda n, head: F.bit_xor(n).over(so_far).bitwiseXOR(F.coalesce(f"{n}_before", zero)).bitwiseXOR(F.col(head))
    run_w = F.sum("w").over(so_far) + F.coalesce("w_before", zero) + F.col("hw")
    own = own.join(earlier, ["conv", "part"], "left").select("conv", "depth", run("k1", "h1").alias("r1"), run("k2", "h2").alias("r2"), "w", run_w.alias("sum_w"), "k1", "k2")
    own = own.select("conv", "depth", F.col("r1").alias("k1"), F.col("r2").alias("k2"), "w", "sum_w", F.col("r1").bitwiseXOR(F.col("k1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("k2")).alias("p2"))

    at = F.col("at")
    from_head = convs.select("conv", "head", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("at"))
    from_head = from_head.select("conv", at.cast("long").alias("depth"), h1(at).alias("k1"), h2(at).alias("k2"), F.coalesce(F.get("head", at - 1)["w"], zero).alias("w"), hw(at).alias("sum_w"), h1(F.greatest(at - 1, F.lit(0))).alias("p1"), h2(F.greatest(at - 1, F.lit(0))).alias("p2"))
    return own.unionByName(from_head)


def _joined_ids(ends: DataFrame) -> DataFrame:
    """Per key, the SHA-256 of the ids that end there (rising, comma-joined), from blocks of ids joined in range order."""

    def blocks(batches):
        key, ids = None, []
        for batch in batches:
            for *now, conv in zip(*(batch.column(n).to_pylist() for n in [*_KEY, "conv"]), strict=True):
                if now != key or len(ids) >= JOINED:
                    if ids:
                        yield _block(key, ids)
                    key, ids = now, []
                ids.append(conv)
        if ids:
            yield _block(key, ids)

    def digests(batches):
        key, found = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(batch.column(n).to_pylist() for n in [*_KEY, "ids"]), strict=True):
                if now != key:
                    if found:
                        out.append((*key, found.hexdigest()))
                    key, found = now, hashlib.sha256(ids.encode())
                else:
                    found.update(b"," + ids.encode())
            yield _rows(out)
        if found:
            yield _rows([(*key, found.hexdigest())])

    of_key = "depth long, k1 long, k2 long"
    dealt = ends.select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    joined = dealt.mapInArrow(blocks, f"{of_key}, least long, ids string")
    return joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "least").mapInArrow(digests, f"{of_key}, ends_sha256 string")


def _block(key: list, ids: list) -> pa.RecordBatch:
    return pa.record_batch([*([x] for x in key), [ids[0]], [",".join(map(str, ids))]], [*_KEY, "least", "ids"])


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [*_KEY, "ends_sha256"])


def trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 for each node of paths as rebuilt gives them."""
    paths = stored(paths)
    before = F.col("sum_w") - F.col("w")
    lengths = paths.groupBy("conv").agg(F.max("depth").alias("size"), F.max("sum_w").alias("all_w"))

    # Owners: the least member of each node, and of each owner the first owned depth, the tokens before it, and whether its end is a leaf.
    sized = paths.join(lengths, "conv")
    owned = sized.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.min(before).alias("before"), F.max("size").alias("deepest"))
    owners = owned.groupBy("conv").agg(F.min("depth").alias("since"), F.min("before").alias("since_w"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    convs = cut(lengths.join(owners, "conv", "left").select("conv", "size", "since", F.coalesce("since_w", "all_w").alias("since_w"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")))

    marked = paths.join(convs, "conv")
    one = lambda x: F.sum(F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    nodes = marked.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        one((F.col("since") <= F.col("depth") + 1) & (F.col("depth") < F.col("size"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("since_w") - before, F.lit(0))).cast("long").alias("saved_tokens"),
        F.max(F.coalesce(F.col("since") == F.col("depth"), F.lit(False))).alias("branch"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    ends = _joined_ids(marked.where("depth = size"))
    nodes = cut(nodes.join(ends, _KEY, "left"))

    # A node that doesn't begin its owner's suffix has its parent's owner; the others look it up, those below the root in one row.
    root = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("root")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    deep = F.col("branch") & (F.col("depth") > 1)
    plain = nodes.where(~deep).crossJoin(root).withColumn("parent", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("branch"), F.col("root")).otherwise(F.col("conv_id")))
    looked = nodes.where(deep).join(parents, ["depth", "p1", "p2"])
    out = plain.drop("root").unionByName(looked)
    return out.select("conv_id", "depth", F.col("parent").cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations."""
    return trie(rebuilt(conversations, **columns))
