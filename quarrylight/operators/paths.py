"""Reachability over several hops, with the way there: a frontier loop over DataFrames.

The links are written to the shared folder once and read by each hop. A hop joins the frontier with them, keeps one predecessor for each new node (the least), takes out what was visited, and is written
to the shared folder, so that a lost executor costs one hop at most. A hub's links are split by adaptive execution's skew
join; what a hop brings is aggregated before it is shuffled, so a node that many others point to is one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import shared, text
from quarrylight.operators import lookup

MAX_HOPS = 3
#: Rows of a frontier that may go to all tasks, so that the links stay where they are.
SMALL = 100_000


def links(edges: DataFrame, direction: str = "outgoing", relations: list[str] | None = None) -> DataFrame:
    """a, b, relation and confidence of each step that may be taken; of several edges between two nodes the least relation counts."""
    e = edges.where(F.col("relation").isin(*lookup.relations(relations)))
    one = lambda a, b: e.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct("relation", "confidence").alias("by"))
    sides = {"outgoing": [one("source_node_id", "target_node_id")], "incoming": [one("target_node_id", "source_node_id")]}
    sides["both"] = sides["outgoing"] + sides["incoming"]
    if direction not in sides:
        raise ValueError(f"direction must be one of {', '.join(sides)}")
    out = sides[direction][0]
    for more in sides[direction][1:]:
        out = out.unionByName(more)
    return out.groupBy("a", "b").agg(F.min("by").alias("by")).select("a", "b", "by.relation", "by.confidence")


def reach(steps: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """start, node_id, hops (the least), previous, relation, confidence and path of every node within some hops of the starts.

    `steps` as links gives them; `starts` has node_id. Starts come with 0 hops. Of several ways of equal length the one through the least
    previous node counts, hop by hop.
    """
    spark = steps.sparkSession
    stored = shared.new_path(spark, "links")
    steps.write.parquet(stored)  # made once: every hop reads them
    steps = spark.read.schema(steps.schema).parquet(stored)
    none = F.lit(None).cast("string")
    front = starts.select(F.col("node_id").alias("start"), "node_id").distinct()
    front = front.select("start", "node_id", F.lit(0).alias("hops"), none.alias("previous"), none.alias("relation"), none.alias("confidence"), F.array("node_id").alias("path")).checkpoint()
    visited = front
    for hop in range(1, max_hops + 1):
        near = front.select("start", F.col("node_id").alias("a"), "path")
        met = steps.join(F.broadcast(near) if front.count() <= SMALL else near, "a")  # SMALL rows
        new = met.groupBy("start", F.col("b").alias("node_id")).agg(F.min(F.struct(F.col("a").alias("previous"), "relation", "confidence", "path")).alias("x"))
        new = new.join(visited.select("start", "node_id"), ["start", "node_id"], "left_anti")
        front = new.select("start", "node_id", F.lit(hop).alias("hops"), "x.previous", "x.relation", "x.confidence", F.concat("x.path", F.array("node_id")).alias("path")).checkpoint()
        visited = visited.unionByName(front)
    return visited


def related_files(edges: DataFrame, nodes: DataFrame, starts: DataFrame, max_hops: int = 2, relations: list[str] | None = None) -> DataFrame:
    """file_path, relation, confidence, hop_count and path: files of nodes within some hops in any direction, but the starts' own files.

    For each file the nearest node counts, of several the one of least id.
    """
    found = reach(links(edges, "both", relations), starts, max_hops)
    placed = found.join(nodes.select("node_id", text.posix(F.col("source_file")).alias("file_path")), "node_id").where("file_path <> ''")
    own = placed.where("hops = 0").select("file_path").distinct()
    nearest = placed.where("hops > 0").groupBy("file_path").agg(F.min(F.struct("hops", "node_id", "relation", "confidence", "path")).alias("x"))
    return nearest.join(own, "file_path", "left_anti").select("file_path", "x.relation", "x.confidence", F.col("x.hops").alias("hop_count"), "x.path")
