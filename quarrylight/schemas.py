"""Table and result schemas, value domains, and the version of stored generations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2

# The closed domains of the data model.
FILE_TYPES = ("source", "test", "config", "doc")
PARSE_STATUSES = ("pending", "parsed", "error", "not_applicable")
SYMBOL_TYPES = ("function", "class", "method", "route", "variable")
NODE_TYPES = ("file", "function", "class", "method", "route", "import", "test")
RELATIONS = ("defines", "imports", "inherits", "calls", "tests", "handles_route")
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
CHUNK_TYPES = ("file_summary", "function", "class", "method", "route", "test", "readme_section", "config")
SEARCH_MODES = ("text", "semantic", "hybrid")
DIRECTIONS = ("outgoing", "incoming", "both")
SEVERITIES = ("warning", "error")


def _struct(spec: str) -> T.StructType:
    """'a string, b int!' as a StructType; ! marks columns that are never null."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "bool": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")) for name, kind in fields])


REPOSITORIES = _struct("id string!, path string!, content_hash string, indexed_at timestamp")
FILES = _struct("id string!, repo_id string!, path string!, absolute_path string!, language string, file_type string!, size_bytes long!, line_count long!, content_hash string, has_secrets bool!, parse_status string!, parse_error string, indexed_at timestamp")
SYMBOLS = _struct("id string!, repo_id string!, file_id string!, symbol_type string!, name string!, qualified_name string, signature string, docstring string, start_line int!, end_line int!, parent_symbol_id string, metadata string")
CHUNKS = _struct("id string!, repo_id string!, file_id string!, symbol_id string, chunk_type string!, content string!, content_hash string, language string, symbol_name string, file_path string!, start_line int!, end_line int!, metadata string")
NODES = _struct("id string!, repo_id string!, node_id string!, label string!, node_type string!, source_file string!, source_location string, confidence string!, metadata string")
EDGES = _struct("id string!, repo_id string!, source_node_id string!, target_node_id string!, relation string!, confidence string!, source_file string, metadata string")
EMBEDDINGS = _struct("chunk_id string!, repo_id string!, file_path string!, symbol_name string!, chunk_type string!, language string!, start_line int!, end_line int!, vector floats!")
STATUS = _struct("repo_id string!, status string!, embedding_model string, active_search_mode string, started_at timestamp, completed_at timestamp, error_message string, files long, parsed long, not_applicable long, errors long, symbols long, imports long, routes long, tests long, chunks long, vectors long, nodes long, edges long, warnings long, fatal_errors long")
TOOL_CALLS = _struct("id string!, repo_id string, tool_name string!, arguments string, status string, output_summary string, result_count long, duration_ms long, created_at timestamp")
REPORTS = _struct("id string!, repo_id string!, report_type string!, content string, created_at timestamp")
BUILDS = _struct("id string!, repo_id string!, path string!, status string!, stage string!, generation string, error_code string, error_message string, started_at timestamp, completed_at timestamp")
DIAGNOSTICS = _struct("code string!, severity string!, file_path string, message string!")

#: The tables of one generation.
TABLES = {"repositories": REPOSITORIES, "files": FILES, "symbols": SYMBOLS, "chunks": CHUNKS, "nodes": NODES, "edges": EDGES, "embeddings": EMBEDDINGS, "index_status": STATUS, "diagnostics": DIAGNOSTICS, "tool_call_logs": TOOL_CALLS, "repo_reports": REPORTS}

# What a file is before it is parsed, and what the parser returns for it.
SCANNED = _struct("path string!, absolute_path string!, size_bytes long!, content_hash string!, is_binary bool!, text string!, line_count long!, has_secrets bool!, file_type string!, language string, parse_status string!")
PARSED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("symbols", T.ArrayType(_struct("seq int, symbol_type string, name string, qualified_name string, signature string, docstring string, start_line int, end_line int, parent string, symbol_id string, confidence string, calls strings, bases strings"))),
        T.StructField("imports", T.ArrayType(_struct("seq int, module_name string, imported_name string, alias string, line_number int, is_relative bool"))),
        T.StructField("routes", T.ArrayType(_struct("seq int, route_id string, method string, route_path string, handler_function string, decorator string, start_line int, end_line int"))),
    ]
)

# Results of queries.
SEARCH_HIT = _struct("chunk_id string, source_path string, start_line int, end_line int, chunk_kind string, owner_semantic_key string, display_text string, text_score double, semantic_score double, combined_score double, match_source string")
SYMBOL_RECORD = _struct("semantic_key string, kind string, qualified_name string, source_path string, start_line int, end_line int, parent_semantic_key string")
ROUTE_RECORD = _struct("http_method string, route_path string, handler_semantic_key string, handler_name string, source_path string, decorator_line int, handler_start_line int, handler_end_line int")
RELATED_NODE = _struct("center_identity string, related_node_identity string, node_kind string, qualified_name string, source_path string, relationship_type string, direction string, qualifier string")


def in_domain(column: str, values: tuple[str, ...]) -> Column:
    """Whether a column holds one of a domain's values; null doesn't."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))
