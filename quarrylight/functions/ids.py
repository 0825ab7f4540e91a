"""Identities: file, symbol, route, chunk, node and edge ids as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GRAPH_SCHEMA = "wp5.step3.graph.v1"
DNS_NAMESPACE = uuid.NAMESPACE_DNS.bytes.hex()


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(symbol_type: Column, path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", symbol_type, path, name, line.cast("string"))


def test_node_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", F.lit("test"), path, name, line.cast("string"))


def import_node_id(path: Column, module: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", F.lit("import"), path, module, name, line.cast("string"))


def uuid5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """The version 5 UUID of a name: SHA-1 over namespace and name, version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(file: Column, chunk_type: Column, start: Column, end: Column, symbol: Column, content_hash: Column) -> Column:
    return uuid5(F.concat_ws("|", file, chunk_type, start.cast("string"), end.cast("string"), F.coalesce(symbol, F.lit("")), content_hash))


def json_text(value: Column) -> Column:
    """A string as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    inner = F.to_json(F.struct(value.alias("v")))
    return F.substr(inner, F.lit(6), F.length(inner) - 6)


def _object(**fields: Column) -> Column:
    """A compact JSON object with its keys in order."""
    parts: list[Column] = [F.lit("{")]
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(f'{"," if i else ""}"{key}":'), json_text(fields[key])]
    return F.concat(*parts, F.lit("}"))


def node_record_id(node_id: Column, node_type: Column) -> Column:
    return F.concat(F.lit("gn:"), F.sha2(_object(schema=F.lit(GRAPH_SCHEMA), kind=F.lit("node"), node_id=node_id, node_type=node_type), 256))


def edge_record_id(source: Column, relation: Column, target: Column, source_file: Column, source_location: Column) -> Column:
    return F.concat(F.lit("ge:"), F.sha2(_object(schema=F.lit(GRAPH_SCHEMA), kind=F.lit("edge"), source_node_id=source, target_node_id=target, relation=relation, source_file=source_file, source_location=source_location), 256))
