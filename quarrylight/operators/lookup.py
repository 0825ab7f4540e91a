"""Lookups of symbols and routes, one-hop neighbours, and first-order impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.functions import text


def find_symbols(symbols: DataFrame, files: DataFrame, query: str, limit: int, exact: bool = False) -> DataFrame:
    """schemas.SYMBOL_RECORD. Exact: the name or qualified name as it stands. Else % and _ are wildcards, and paths count too;
    equal qualified names come first, then equal names, then the rest by line."""
    joined = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    named = (F.col("qualified_name") == query) | (F.col("name") == query)
    if exact:
        found, tier = joined.where(named), F.lit(0)
    else:
        pattern = f"%{query}%"
        found = joined.where(text.like(F.col("name"), pattern) | text.like(F.coalesce("qualified_name", F.lit("")), pattern) | text.like(F.col("path"), pattern))
        tier = F.when(F.col("qualified_name") == query, 0).when(F.col("name") == query, 1).otherwise(2)
    out = found.withColumn("tier", tier).orderBy("tier", "start_line", "id").limit(limit)
    return out.select(F.col("id").alias("semantic_key"), F.col("symbol_type").alias("kind"), F.coalesce(F.nullif(F.col("qualified_name"), F.lit("")), F.col("name")).alias("qualified_name"), text.posix(F.col("path")).alias("source_path"), "start_line", "end_line", F.col("parent_symbol_id").alias("parent_semantic_key"))


def find_routes(symbols: DataFrame, files: DataFrame, method: str | None = None, path_query: str | None = None, handler_query: str | None = None, limit: int = 50) -> DataFrame:
    """schemas.ROUTE_RECORD of route symbols, named `METHOD path`; the path is looked for in the whole name."""
    found = symbols.where("symbol_type = 'route'").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if method:
        found = found.where(text.like(F.col("name"), f"{method.upper()}%"))
    if path_query:
        found = found.where(text.like(F.col("name"), f"%{path_query}%"))
    if handler_query:
        found = found.where(text.like(F.coalesce("qualified_name", F.lit("")), f"%{handler_query}%"))
    spaced = F.contains(F.col("name"), F.lit(" "))
    handler = F.coalesce("qualified_name", F.lit(""))
    return (
        found.orderBy("start_line", "id")
        .limit(limit)
        .select(
            F.upper(F.when(spaced, F.substring_index("name", " ", 1)).otherwise("GET")).alias("http_method"),
            F.when(spaced, F.expr("substring(name, locate(' ', name) + 1)")).otherwise("").alias("route_path"),
            handler.alias("handler_semantic_key"),
            F.substring_index(handler, ".", -1).alias("handler_name"),
            text.posix(F.col("path")).alias("source_path"),
            F.col("start_line").alias("decorator_line"),
            F.col("start_line").alias("handler_start_line"),
            F.col("end_line").alias("handler_end_line"),
        )
    )


def resolve(nodes: DataFrame, key: str, symbol_nodes: DataFrame | None = None) -> DataFrame:
    """At most one node: by record id, else by node id, else (where the map is given) by the id of its symbol."""
    tier = F.when(F.col("id") == key, 0).when(F.col("node_id") == key, 1)
    found = nodes.withColumn("tier", tier)
    if symbol_nodes is not None:
        of_symbol = symbol_nodes.where(F.col("symbol_id") == key).select("node_id", F.lit(2).alias("by_symbol"))
        found = found.join(of_symbol, "node_id", "left").withColumn("tier", F.coalesce("tier", "by_symbol")).drop("by_symbol")
    return found.where("tier is not null").orderBy("tier", "id").limit(1).drop("tier")


def relations(edge_types: list[str] | None) -> list[str]:
    """The known ones among the types asked for; all if none is."""
    known = [r for r in schemas.RELATIONS if r in (edge_types or ())]
    return known or list(schemas.RELATIONS)


def neighbours(edges: DataFrame, nodes: DataFrame, center: Column | str, direction: str, edge_types: list[str] | None = None) -> DataFrame:
    """schemas.RELATED_NODE with edge_id and record_id, one row for each edge out of or into a node."""
    here, there = ("source_node_id", "target_node_id") if direction == "outgoing" else ("target_node_id", "source_node_id")
    chosen = edges.where((F.col(here) == center) & F.col("relation").isin(*relations(edge_types)))
    e = chosen.select(F.col("id").alias("edge_id"), F.col(there).alias("node_id"), "relation", F.col("confidence").alias("edge_confidence"), F.col("metadata").alias("edge_metadata"))
    n = nodes.select("node_id", F.col("id").alias("record_id"), "node_type", "label", "source_file")
    return e.join(n, "node_id").select(
        F.lit("").alias("center_identity"),
        F.col("node_id").alias("related_node_identity"),
        F.col("node_type").alias("node_kind"),
        F.coalesce("label", F.lit("")).alias("qualified_name"),
        text.posix(F.col("source_file")).alias("source_path"),
        F.col("relation").alias("relationship_type"),
        F.lit(direction).alias("direction"),
        F.coalesce(F.get_json_object("edge_metadata", "$.qualifier"), F.col("edge_confidence")).alias("qualifier"),
        "edge_id",
        "record_id",
    )


def related(edges: DataFrame, nodes: DataFrame, center: str, direction: str = "both", edge_types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """schemas.RELATED_NODE: outgoing edges fill the limit first, each side by relation."""
    sides = schemas.DIRECTIONS[:2] if direction == "both" else (direction,)
    found = [neighbours(edges, nodes, center, side, edge_types).withColumn("side", F.lit(schemas.DIRECTIONS.index(side))) for side in sides]
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out.orderBy("side", "relationship_type", "related_node_identity", "edge_id").limit(limit).select(*schemas.RELATED_NODE.names)


#: What of a node's neighbourhood counts as impact: category, direction, relation, kind of the other node or None.
IMPACT = [
    ("direct_callers", "incoming", "calls", None),
    ("direct_callees", "outgoing", "calls", None),
    ("containing_file", "incoming", "defines", "file"),
    ("containing_class", "incoming", "defines", "class"),
    ("import_relationships", "outgoing", "imports", None),
    ("route_relationships", "outgoing", "handles_route", None),
    ("related_tests", "outgoing", "tests", None),
]


def impact(edges: DataFrame, nodes: DataFrame, center: str, limit: int = 100, *, tests_direction: str = "outgoing") -> DataFrame:
    """category and schemas.RELATED_NODE (with record_id) for each category of IMPACT, `limit` rows in each, one for containers.

    The neighbourhood is joined once; categories are told apart by a predicate.
    """
    around = neighbours(edges, nodes, center, "outgoing").unionByName(neighbours(edges, nodes, center, "incoming"))
    category = None
    for name, direction, relation, kind in IMPACT:
        side = tests_direction if relation == "tests" else direction
        this = (F.col("direction") == side) & (F.col("relationship_type") == relation)
        if kind:
            this = this & (F.col("node_kind") == kind)
        category = F.when(this, name) if category is None else category.when(this, name)
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("category").orderBy("related_node_identity", "edge_id"))
    most = F.when(F.col("category").startswith("containing"), 1).otherwise(limit)
    return around.withColumn("category", category).where("category is not null").withColumn("row", row).where(F.col("row") <= most).drop("row")
