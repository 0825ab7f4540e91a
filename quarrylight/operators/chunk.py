"""Files to chunks, in column expressions: summaries, symbols, routes, document sections and blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import ids, text

# Fixed values.
SUMMARY_LINES, BLOCK_LINES = 20, 100
MD_HEADING = r"^#{1,6}\s"
RST_RULE = r"^[=\-~^`:'\"._*+#<>!@$%&]{3,}\s*$"

COLUMNS = ["id", "file_id", "symbol_id", "chunk_type", "content", "content_hash", "language", "symbol_name", "file_path", "start_line", "end_line", "has_secrets", "parse_status", "metadata"]


def _finish(df: DataFrame, metadata: dict[str, Column]) -> DataFrame:
    """Chunks without content go; ids, hashes and metadata are added. `df` has the other COLUMNS and has_secrets, parse_status."""
    df = df.where("content <> ''").withColumn("content_hash", F.sha2("content", 256)).withColumn("file_id", ids.file_id(F.col("file_path")))
    known = {"has_secrets": F.col("has_secrets"), "parse_status": F.col("parse_status")} | metadata
    meta = F.to_json(F.struct(*(known[k].alias(k) for k in sorted(known))))
    chunk = ids.chunk_id(F.col("file_id"), F.col("chunk_type"), F.col("start_line"), F.col("end_line"), F.col("symbol_id"), F.col("content_hash"))
    return df.withColumn("id", chunk).withColumn("metadata", meta).select(*COLUMNS)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def file_summaries(files: DataFrame, imports: DataFrame) -> DataFrame:
    """For each Python file its distinct imports in order, then its first lines."""
    line = F.concat(F.lit("import "), F.when(F.col("module_name") != "", F.col("module_name")).otherwise(F.col("imported_name")))
    listed = imports.groupBy("path").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])).alias("listed"))
    first = F.array_join(F.slice(text.lines(F.col("text")), 1, SUMMARY_LINES), "\n")
    df = files.join(listed, "path", "left").withColumn("first", first)
    known = F.coalesce("listed", F.array().cast("array<string>"))
    content = F.array_join(F.when(F.array_contains(known, F.col("first")), known).otherwise(F.concat(known, F.array("first"))), "\n")
    end = F.when(F.col("line_count") > 0, F.least(F.lit(SUMMARY_LINES), F.col("line_count"))).otherwise(1).cast("int")
    out = df.select(F.col("path").alias("file_path"), content.alias("content"), F.lit(1).alias("start_line"), end.alias("end_line"), F.lit("file_summary").alias("chunk_type"), _null().alias("symbol_id"), _null().alias("symbol_name"), F.lit("Python").alias("language"), "has_secrets", "parse_status")
    return _finish(out, {})


def symbol_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The lines of functions, methods and tests; of classes the header and the docstring."""
    df = symbols.where("symbol_type in ('function', 'class', 'method')").join(files, "path")
    tested = F.col("name").startswith("test_") | ((F.col("symbol_type") == "class") & F.col("name").startswith("Test")) | (F.col("file_type") == "test")
    kind = F.when(tested, "test").otherwise(F.col("symbol_type"))
    body = text.line_range(text.lines(F.col("text")), F.col("start_line"), F.col("end_line"))
    header = F.concat_ws("\n", text.line_range(text.lines(F.col("text")), F.col("start_line"), F.col("start_line")), F.when(F.col("docstring") != "", F.col("docstring")))
    content = F.when(kind == "class", F.when(body != "", header).otherwise("")).otherwise(body)
    out = df.select(F.col("path").alias("file_path"), content.alias("content"), "start_line", "end_line", kind.alias("chunk_type"), "symbol_id", F.col("name").alias("symbol_name"), F.lit("Python").alias("language"), "has_secrets", "parse_status", "qualified_name", "signature", "docstring")
    return _finish(out, {k: F.col(k) for k in ("qualified_name", "signature", "docstring")})


def route_chunks(files: DataFrame, routes: DataFrame) -> DataFrame:
    """From the decorator to the end of the handler."""
    df = routes.join(files, "path")
    content = text.line_range(text.lines(F.col("text")), F.col("start_line"), F.col("end_line"))
    name = F.concat_ws(" ", "method", "route_path")
    out = df.select(F.col("path").alias("file_path"), content.alias("content"), "start_line", "end_line", F.lit("route").alias("chunk_type"), F.col("route_id").alias("symbol_id"), name.alias("symbol_name"), F.lit("Python").alias("language"), "has_secrets", "parse_status", F.col("method").alias("http_method"), "route_path", "handler_function", "decorator")
    return _finish(out, {"http_method": F.col("http_method"), "route_path": F.col("route_path"), "handler_function": F.col("handler_function"), "decorators": F.array("decorator"), "qualified_name": F.col("handler_function")})


def sections(files: DataFrame, heading: Column, key: str = "path", body: str = "text") -> DataFrame:
    """key, section, start_line, end_line, content, heading: runs of lines that each begin at a heading.

    `heading` is a boolean over `line` and `below` (the next line, null at the end). Lines before the first
    heading are section 0. Content is stripped; blank sections go.
    """
    numbered = files.select(key, F.posexplode(text.lines(F.col(body))).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    marked = numbered.withColumn("below", F.lead("line").over(order)).withColumn("opens", F.coalesce(heading, F.lit(False)))
    split = marked.withColumn("section", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = split.groupBy(key, "section").agg((F.min("at") + 1).alias("start_line"), (F.max("at") + 1).alias("end_line"), F.array_sort(F.collect_list(F.struct("at", "line", "below"))).alias("rows"))
    out = grouped.select(key, F.col("section").cast("int").alias("section"), "start_line", "end_line", text.strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("content"), F.col("rows")[0]["line"].alias("first"), F.col("rows")[0]["below"].alias("below"))
    return out.where("content <> ''")


def section_chunks(files: DataFrame) -> DataFrame:
    """Markdown and reStructuredText files by headings."""
    ext = text.extension(F.col("path"))
    of_md, of_rst = files.where(ext == ".md"), files.where(ext == ".rst")
    md = sections(of_md, F.col("line").rlike(MD_HEADING)).withColumn("title", text.strip(F.regexp_replace("first", "^#+", ""))).withColumn("level", F.length(F.regexp_extract("first", "^(#+)", 1)).cast("string")).withColumn("language", F.lit("Markdown"))
    rst = sections(of_rst, F.col("below").rlike(RST_RULE)).withColumn("title", text.strip(F.col("first"))).withColumn("level", F.substring("below", 1, 1)).withColumn("language", F.lit("RST"))
    df = md.unionByName(rst).join(files.select("path", "has_secrets"), "path")
    opened = F.col("section") > 0
    out = df.select(F.col("path").alias("file_path"), "content", "start_line", "end_line", F.lit("readme_section").alias("chunk_type"), _null().alias("symbol_id"), _null().alias("symbol_name"), "language", "has_secrets", F.lit("not_applicable").alias("parse_status"), F.when(opened, F.col("title")).alias("heading"), F.when(opened, F.col("level")).alias("heading_level"))
    return _finish(out, {"heading": F.col("heading"), "heading_level": F.col("heading_level")})


def blocks(files: DataFrame, size: int = BLOCK_LINES, key: str = "path", body: str = "text") -> DataFrame:
    """key, block_index, block_count, start_line, end_line, content: consecutive blocks of lines; blank ones go."""
    split = files.select(key, text.lines(F.col(body)).alias("all_lines")).withColumn("total", F.size("all_lines"))
    cut = split.select(key, "total", F.inline(F.expr(f"transform(sequence(0, (total - 1) div {size}), i -> struct(cast(i as int) as block_index, slice(all_lines, cast(i as int) * {size} + 1, {size}) as part))")))
    count = F.ceil(F.col("total") / size).cast("int")
    out = cut.select(key, "block_index", count.alias("block_count"), (F.col("block_index") * size + 1).alias("start_line"), F.least((F.col("block_index") + 1) * size, F.col("total")).alias("end_line"), F.array_join("part", "\n").alias("content"))
    return out.where(~text.is_blank(F.col("content")))


def config_chunks(files: DataFrame, more_names: tuple[str, ...] = (".quarryignore",)) -> DataFrame:
    """Configuration files in blocks of 100 lines."""
    taken = text.extension(F.col("path")).isin(".py", ".pyw", ".md", ".rst")
    chosen = files.where(~taken & text.is_config_chunked(F.col("path"), more_names))
    df = blocks(chosen).join(chosen.select("path", "has_secrets"), "path")
    out = df.select(F.col("path").alias("file_path"), "content", "start_line", "end_line", F.lit("config").alias("chunk_type"), _null().alias("symbol_id"), _null().alias("symbol_name"), _null().alias("language"), "has_secrets", F.lit("not_applicable").alias("parse_status"), "block_index", "block_count")
    return _finish(out, {"block_index": F.col("block_index"), "block_count": F.col("block_count")})


def chunks(scanned: DataFrame, parsed: DataFrame) -> DataFrame:
    """All chunks of a repository; `scanned` as schemas.SCANNED, `parsed` as schemas.PARSED."""
    from quarrylight.operators import parse

    full = scanned.where(~text.is_blank(F.col("text")))
    known = full.drop("parse_status").join(parsed.select("path", F.col("status").alias("parse_status")), "path").select("path", "text", "line_count", "has_secrets", "file_type", "parse_status")
    good = known.where("parse_status = 'parsed'")
    out = file_summaries(known, parse.imports(parsed))
    for more in (symbol_chunks(good, parse.symbols(parsed)), route_chunks(good, parse.routes(parsed)), section_chunks(full), config_chunks(full)):
        out = out.unionByName(more)
    return out


def ordered(df: DataFrame) -> DataFrame:
    """In the order of files (without regard to case), then lines, type, name and id."""
    return df.orderBy(F.lower("file_path"), "file_path", "start_line", "end_line", "chunk_type", F.coalesce("symbol_name", F.lit("")), "id")


def unmatched(scanned: DataFrame, parsed: DataFrame) -> DataFrame:
    """path and problem: parsed files that weren't scanned, and Python files waiting for a parse that has not come."""
    lost = parsed.join(scanned, "path", "left_anti").select("path", F.lit("parsed_without_scan").alias("problem"))
    waiting = scanned.where("parse_status = 'pending'").join(parsed, "path", "left_anti").select("path", F.lit("scan_without_parse").alias("problem"))
    return lost.unionByName(waiting)
