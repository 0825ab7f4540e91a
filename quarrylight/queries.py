"""The operators over the test tables, each with the same rows in DuckDB's SQL where SQL can express them.

A document stands for a file, a part for a symbol, a page for a route; regions, nations, customers, suppliers, orders
and parts form the graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight import schemas
from quarrylight.functions import ids, secrets, shared, text, vectors
from quarrylight.operators import ann, bands, chunk, embed, extensions, fulltext, graph, inverted, lookup, parse, paths, rules, search, validate
from quarrylight.sources import inputs, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def java_to_re2(new: str) -> str:
    return "".join("\\" + c if new[i - 1 : i] == "$" else "" if c == "$" else c for i, c in enumerate(new))


# Documents as files.

DOC_PATH = "source || '/doc_' || doc_id || '.md'"
LINES = "string_split(text, chr(10))"
STRIP = f"regexp_replace(regexp_replace({{0}}, {quoted('^' + text._BLANK)}, ''), {quoted(text._BLANK + chr(92) + 'z')}, '')"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with path."""
    return table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")))


@query(f"""
SELECT {DOC_PATH} AS path, strlen(text) AS size_bytes, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS line_count,
  sha256(text) AS content_hash, 'doc' AS file_type, 'file:' || {DOC_PATH} AS id FROM documents""")
def scan_files_projection(spark, sf_dir):
    d = doc_files(spark, sf_dir)
    return d.select("path", F.octet_length("text").cast("long").alias("size_bytes"), text.line_count(F.col("text")).alias("line_count"), F.sha2("text", 256).alias("content_hash"), text.file_type(F.col("path")).alias("file_type"), ids.file_id(F.col("path")).alias("id"))


_REDACTED = f"regexp_replace(text, {quoted(secrets._PEM)}, {quoted(java_to_re2('$1' + secrets.REDACTED + '$3'))}, 'g')"
for _pattern, _new in secrets._PATTERNS:
    _REDACTED = f"regexp_replace({_REDACTED}, {quoted(_pattern)}, {quoted(java_to_re2(_new))}, 'g')"
_HAS = " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in (secrets._QUOTED, secrets._BARE, secrets._PEM))


@query(f"SELECT doc_id, {_HAS} AS has_secrets, sha256({_REDACTED}) AS safe_hash FROM documents")
def secret_detect_redact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", secrets.has_secret(F.col("text")).alias("has_secrets"), F.sha2(secrets.redact(F.col("text")), 256).alias("safe_hash"))


@query("""
SELECT doc_id, n, bytes, n > 500 OR bytes > 1000000 AS over FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, CAST(sum(strlen(text)) OVER (ORDER BY doc_id) AS BIGINT) AS bytes FROM documents)""")
def scan_limits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size_bytes"))
    return scan.over_limits(d, "doc_id", max_files=500, max_bytes=1_000_000).select("doc_id", "n", "bytes", "over")


@query("""
SELECT page_id, CASE WHEN url IS NULL THEN 'file_skipped' WHEN html = '' THEN 'file_skipped' WHEN strlen(html) > 5000 THEN 'file_skipped' END AS reason, strlen(html) AS size_bytes FROM pages""")
def scan_suitability(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size_bytes"), "url")
    reason = F.when(F.col("url").isNull() | (F.col("size_bytes") == 0) | (F.col("size_bytes") > 5000), "file_skipped")
    return p.select("page_id", reason.alias("reason"), "size_bytes")


_RULES = scan.IgnoreRules.of(["*7", "/fr/", "de/4*", "tag/", "src1/*"])
_PAGE_PATH = "regexp_replace(regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1), '/+$', '')"


@query(f"""
SELECT 'page' AS kind, page_id AS key, regexp_matches({_PAGE_PATH}, {quoted(_RULES.regex)}) AS ignored FROM pages
UNION ALL SELECT 'document', doc_id, regexp_matches({DOC_PATH}, {quoted(_RULES.regex)}) FROM documents""")
def ignore_rules_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.regexp_replace(F.regexp_extract("url", "^[^:]*://[^/]*/([^?#]*)", 1), "/+$", "").alias("path"))
    d = doc_files(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), "path")
    return p.unionByName(d).select("kind", "key", _RULES.column(F.col("path")).alias("ignored"))


@query("""
SELECT page_id, lower(split_part(u, '/', 4)) AS owner, regexp_replace(split_part(u, '/', 5), '\\.git$', '') AS name
FROM (SELECT page_id, 'https://github.com/' || regexp_extract(url, '://([^/.]+)', 1) || '/' || 'repo' || page_id || '.git' AS u FROM pages)""")
def github_url_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://github.com/"), F.regexp_extract("url", "://([^/.]+)", 1), F.lit("/repo"), F.col("page_id").cast("string"), F.lit(".git")).alias("u"))
    pattern = r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$"
    return p.select("page_id", F.lower(F.regexp_extract("u", pattern, 1)).alias("owner"), F.regexp_extract("u", pattern, 2).alias("name"))


@query("""
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'ignored_by_rules' WHEN page_id % 13 = 0 THEN 'symlink_skipped' WHEN page_id % 17 = 0 THEN 'file_skipped: could not stat or read file'
  WHEN n = 0 THEN 'file_skipped: empty file' WHEN page_id % 4 = 1 THEN 'file_skipped: binary file' WHEN page_id % 19 = 0 THEN 'file_skipped: could not read file'
  WHEN n > 1048576 THEN 'file_skipped: file too large' END AS reason
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) * CASE WHEN page_id % 5 = 0 THEN 1000 ELSE 1 END AS n FROM pages)""")
def suitability_rules(spark, sf_dir):
    """Pages as files in the scanner's own judgement; every fifth stands for a file a thousand times as large."""
    n = F.col("page_id")
    name = F.concat(F.lit("site/page_"), n.cast("string"), F.element_at(F.array(*map(F.lit, (".html", ".exe", ".txt", ".py"))), (n % 4 + 1).cast("int")))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long") * F.when(n % 5 == 0, 1000).otherwise(1)
    read = table(spark, sf_dir, "pages").select("page_id", name.alias("path"), (n % 11 == 0).alias("ignored"), (n % 13 == 0).alias("is_link"), F.when(n % 17 != 0, size).alias("size_bytes"), F.when(n % 19 != 0, F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("content"))
    reason = scan.skip_reason(read)
    short = F.when(reason.startswith("file_skipped"), F.regexp_replace(reason, r" \(.*", "")).otherwise(F.substring_index(reason, ":", 1))
    return read.select("page_id", short.alias("reason"))


@query("""
SELECT page_id, owner, 'repo' || page_id AS name FROM (SELECT page_id, regexp_extract(url, '://([^/.]+)', 1) AS owner FROM pages)
WHERE page_id % 3 <> 0 AND regexp_matches(owner, '^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$')""")
def github_urls(spark, sf_dir):
    """The operator itself over URLs made of the pages' hosts; every third is of another site."""
    n = F.col("page_id").cast("string")
    site = F.when(F.col("page_id") % 3 == 0, "https://example.com/").otherwise("https://www.github.com/")
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(site, F.regexp_extract("url", "://([^/.]+)", 1), F.lit("/repo"), n, F.lit(".git/")).alias("u"))

    def parsed(frames):
        for frame in frames:
            found = [inputs.parse_github_url(u or "") for u in frame["u"]]
            kept = [f is not None for f in found]
            yield frame.loc[kept, ["page_id"]].assign(owner=[f[0] for f in found if f], name=[f[1] for f in found if f])

    return made.mapInPandas(parsed, "page_id long, owner string, name string")


@query("""
WITH c AS (
  SELECT doc_id, n_chars % 7 AS a, n_chars % 5 AS b, coalesce(text, '') AS t, CASE WHEN doc_id % 40 = 1 THEN '/x' WHEN doc_id % 40 = 2 THEN 'x/../y' ELSE source END AS p, doc_id // 2 AS id FROM documents)
SELECT rule, doc_id AS place FROM (
  SELECT 'absolute_path' AS rule, doc_id FROM c WHERE p = '/x' UNION ALL SELECT 'path_leaves_root', doc_id FROM c WHERE p = 'x/../y'
  UNION ALL SELECT 'bad_first_line', doc_id FROM c WHERE a < 1 UNION ALL SELECT 'bad_last_line', doc_id FROM c WHERE b < a
  UNION ALL SELECT 'blank_content', doc_id FROM c WHERE NOT regexp_matches(t, '[^\x09-\x0D ]')
  UNION ALL SELECT 'bad_content_hash', doc_id FROM c WHERE doc_id % 50 = 0 UNION ALL SELECT 'bad_chunk_type', doc_id FROM c WHERE doc_id % 60 = 0
  UNION ALL SELECT 'unknown_file', doc_id FROM c WHERE p IN ('/x', 'x/../y') OR p = 'src1' UNION ALL SELECT 'repeated_chunk_id', max(doc_id) FROM c GROUP BY id HAVING count(*) > 1)""")
def chunk_rules(spark, sf_dir):
    """Documents as chunks with faults: the rule engine's violations."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    content = F.coalesce("text", F.lit(""))
    rows = d.select(n.alias("place"), F.floor(n / 2).cast("string").alias("id"), F.when(n % 40 == 1, "/x").when(n % 40 == 2, "x/../y").otherwise(F.col("source")).alias("file_path"), (F.col("n_chars") % 7).alias("start_line"), (F.col("n_chars") % 5).alias("end_line"), content.alias("content"), F.when(n % 50 == 0, "0").otherwise(F.sha2(content, 256)).alias("content_hash"), F.when(n % 60 == 0, "page").otherwise("config").alias("chunk_type"))
    files = d.where("source <> 'src1'").select(F.col("source").alias("path")).distinct()
    return rules.violations("chunks", {"chunks": rows, "files": files}, "place").select("rule", "place")


# Chunks.


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, ls, unnest(range(0, (len(ls) + 9) // 10)) AS block_index FROM s),
c AS (SELECT doc_id, CAST(block_index AS INTEGER) AS block_index, CAST((len(ls) + 9) // 10 AS INTEGER) AS block_count, CAST(block_index * 10 + 1 AS INTEGER) AS start_line,
  CAST(least((block_index + 1) * 10, len(ls)) AS INTEGER) AS end_line, array_to_string(ls[block_index * 10 + 1 : (block_index + 1) * 10], chr(10)) AS content FROM b)
SELECT doc_id, block_index, block_count, start_line, end_line, sha256(content) AS content_hash FROM c WHERE regexp_matches(content, '[^\\s]')""")
def chunk_config_blocks(spark, sf_dir):
    return chunk.blocks(table(spark, sf_dir, "documents"), 10, key="doc_id").select("doc_id", "block_index", "block_count", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(f"""
SELECT 'file:' || {DOC_PATH} AS file_id, 'file_summary' AS chunk_type, 1 AS start_line,
  CAST(least(20, len(text) - len(replace(text, chr(10), '')) + CASE WHEN NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS INTEGER) AS end_line,
  sha256('import ' || lang || chr(10) || 'import ' || source || chr(10) || array_to_string({LINES}[1:20], chr(10))) AS content_hash FROM documents WHERE text <> ''""")
def chunk_file_summary(spark, sf_dir):
    d = doc_files(spark, sf_dir).where("text <> ''")
    files = d.select("path", "text", text.line_count(F.col("text")).alias("line_count"), F.lit(False).alias("has_secrets"), F.lit("parsed").alias("parse_status"))
    imports = d.select("path", F.inline(F.array(F.struct(F.lit(0).alias("seq"), F.col("lang").alias("module_name"), F.lit("").alias("imported_name")), F.struct(F.lit(1).alias("seq"), F.lit("").alias("module_name"), F.col("source").alias("imported_name")), F.struct(F.lit(2).alias("seq"), F.col("lang").alias("module_name"), F.lit("").alias("imported_name")))))
    return chunk.file_summaries(files, imports).select("file_id", "chunk_type", "start_line", "end_line", "content_hash")


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 60 THEN 1 ELSE 0 END AS opens FROM l),
s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS section FROM m),
g AS (SELECT doc_id, section, CAST(min(pos) AS INTEGER) AS start_line, CAST(max(pos) AS INTEGER) AS end_line, {STRIP.format("string_agg(line, chr(10) ORDER BY pos)")} AS content FROM s GROUP BY doc_id, section)
SELECT doc_id, section, start_line, end_line, sha256(content) AS content_hash FROM g WHERE content <> ''""")
def chunk_sections(spark, sf_dir):
    found = chunk.sections(table(spark, sf_dir, "documents").select("doc_id", "text"), F.char_length("line").between(1, 60), key="doc_id")
    return found.select("doc_id", "section", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:5], chr(10)) AS content FROM documents")
def chunk_line_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_range(text.lines(F.col("text")), F.lit(2), F.lit(5)).alias("content"))


_RAW = f"'file:' || {DOC_PATH} || '|config|1|9||' || sha256(text)"


@query(f"""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
FROM (SELECT doc_id, sha1(unhex('{ids.DNS_NAMESPACE}') || encode({_RAW})) AS h FROM documents)""")
def chunk_id_uuid5(spark, sf_dir):
    d = doc_files(spark, sf_dir)
    made = ids.chunk_id(ids.file_id(F.col("path")), F.lit("config"), F.lit(1), F.lit(9), F.lit(None).cast("string"), F.sha2("text", 256))
    return d.select("doc_id", made.alias("chunk_id"))


@query(f"""
SELECT {DOC_PATH} AS file_path, 'readme_section' AS chunk_type, sha256(text) AS content_hash FROM documents
UNION ALL SELECT url, 'route', sha256(html) FROM pages""")
def chunk_union_sorted(spark, sf_dir):
    d = doc_files(spark, sf_dir).select(F.col("path").alias("file_path"), F.lit("readme_section").alias("chunk_type"), F.col("text").alias("content"))
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("file_path"), F.lit("route").alias("chunk_type"), F.col("html").alias("content"))
    both = d.unionByName(p).select("file_path", "chunk_type", F.sha2("content", 256).alias("content_hash"))
    made = both.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "symbol_name": F.lit(""), "id": F.col("content_hash")})
    return chunk.ordered(made).select("file_path", "chunk_type", "content_hash")


# Embeddings.


@query(f"""
SELECT d.doc_id, regexp_matches(d.text, '[^\\s]') AND NOT ({_HAS.replace("text", "d.text")}) AND coalesce(l.toxic, 0) = 0 AS eligible
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def embedding_eligibility(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = d.join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("content"), secrets.has_secret(F.col("text")).alias("has_secrets"), F.when(F.col("toxic") == 1, "error").otherwise("parsed").alias("parse_status"))
    return known.select("doc_id", embed.eligible(known).alias("eligible"))


@query("""
SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid,
  round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings""")
def vector_validate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", vectors.is_valid(F.col("embedding"), 64).alias("valid"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT strlen(prepared) AS bytes, doc_id FROM (SELECT doc_id, CASE WHEN strlen(text) > 102400 THEN array_to_string(string_split(text, chr(10))[1:100], chr(10)) ELSE text END AS prepared FROM documents)")
def embedding_oversize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(embed.prepared(F.col("text"))).cast("long").alias("bytes"))


@query()
def embedding_hashing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit(False).alias("has_secrets"), F.lit("parsed").alias("parse_status"))
    return embed.encode(d, embed.HashingEncoder(64)).select("id", F.round(vectors.norm(F.col("vector")), 6).alias("norm"), "error")


def _probe(spark, sf_dir) -> list[float]:
    """The vector of least id, as a query."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]]


_SCORES = """
q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.v))), 6) AS score FROM embeddings, q)"""


@query(f"WITH {_SCORES} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 50")
def knn_cosine_top50(spark, sf_dir):
    q = F.array(*map(F.lit, _probe(spark, sf_dir)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.clamped(vectors.cosine(F.col("embedding"), q)), 6).alias("score"))
    return e.orderBy(F.desc("score"), "vec_id").limit(search.SEMANTIC_HITS)


_VECTORS: dict[tuple[str, str], ann.VectorIndex] = {}


def _vector_index(spark, sf_dir) -> ann.VectorIndex:
    known = spark.sparkContext.applicationId, sf_dir
    if known not in _VECTORS:
        _VECTORS[known] = ann.VectorIndex.build(table(spark, sf_dir, "embeddings"), shared.new_path(spark, "vectors"), key="vec_id", vector="embedding")
    return _VECTORS[known]


@query(ORACLE_SQL["knn_cosine_top50"])
def knn_by_index(spark, sf_dir):
    """All lists probed and 200 candidates a hit re-ranked; recall with fewer is measured in the tests."""
    found = _vector_index(spark, sf_dir).search(_probe(spark, sf_dir), 50, probes=ann.LISTS, ranked=200)
    return found.select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("""
SELECT vec_id, round(CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: i * CAST(v[i] AS DOUBLE))) AS DOUBLE), 4) AS weighed FROM (
  SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE vec_id % 7 <> 0
  UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE label = 0)""")
def vectors_after_edits(spark, sf_dir):
    """An index of its own: rows are replaced, taken out and added, then what counts is read."""
    e = table(spark, sf_dir, "embeddings")
    index = ann.VectorIndex.build(e, shared.new_path(spark, "vectors"), key="vec_id", vector="embedding")
    index.upsert(e.where("vec_id % 5 = 0").select("vec_id", F.reverse("embedding").alias("embedding")), key="vec_id", vector="embedding")
    index.delete(e.where("vec_id % 7 = 0"), key="vec_id")
    index.upsert(e.where("label = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "embedding"), key="vec_id", vector="embedding")
    weighed = F.aggregate(F.transform("vector", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return index.rows().select(F.col("key").alias("vec_id"), F.round(weighed, 4).alias("weighed"))


# Full text.

_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _count_sql(phrase: fulltext.Phrase) -> str:
    parts = []
    for c in ("text", "source"):
        if phrase.column not in (None, c):
            continue
        if len(phrase.words) == 1:
            test = f"starts_with(w, {quoted(phrase.words[0])})" if phrase.prefix else f"w = {quoted(phrase.words[0])}"
            parts.append(f"len(list_filter(w_{c}, lambda w: {test}))")
        else:
            tests = " AND ".join(f"w_{c}[i + {k}] = {quoted(w)}" for k, w in enumerate(phrase.words))
            parts.append(f"len(list_filter(range(1, len(w_{c}) + 1), lambda i: {tests}))")
    return " + ".join(parts) or "0"


def _match_sql(node: fulltext.Node, at: dict) -> str:
    if node.phrase is not None:
        return f"tf_{at[node.phrase]} > 0"
    inner = [_match_sql(p, at) for p in node.parts]
    return "(" + (" AND " if node.kind == "and" else " OR " if node.kind == "or" else " AND NOT ").join(inner) + ")"


def fts_sql(q: str, limit: int = 20) -> str:
    tree = fulltext.parse_query(q, ("text", "source"))
    phrases = tree.phrases()
    at = {p: i for i, p in enumerate(phrases)}
    counts = ", ".join(f"{_count_sql(p)} AS tf_{i}" for p, i in at.items())
    dfs = ", ".join(f"count(*) FILTER (WHERE tf_{i} > 0) AS df_{i}" for i in at.values())
    rank = " + ".join(f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 0.000001) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * doc_len / mean_len))" for i in (at[p] for p in fulltext.scored(tree)))
    return f"""
WITH w AS (SELECT doc_id, {_TOKENS.format("text")} AS w_text, {_TOKENS.format("source")} AS w_source FROM documents),
c AS (SELECT doc_id, len(w_text) + len(w_source) AS doc_len, {counts} FROM w),
t AS (SELECT count(*) AS n, avg(doc_len) AS mean_len, {dfs} FROM c),
r AS (SELECT doc_id, round(-({rank}), 6) AS rank FROM c, t WHERE {_match_sql(tree, at)})
SELECT doc_id, rank FROM r ORDER BY rank, doc_id LIMIT {limit}"""


def _fts(q: str):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
        return fulltext.match(d, ("text", "source"), q).select("doc_id", F.round("rank", 6).alias("rank")).orderBy("rank", "doc_id").limit(20)

    return run


FTS = {"fts_single": "wh", "fts_and": "the anea", "fts_or": "wh OR schch", "fts_not": "anea NOT wh", "fts_prefix": "undsch*", "fts_column": "source:src1", "fts_phrase": '"of the"'}
for _name, _q in FTS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _fts(_q), fts_sql(_q)


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'token = \"')")
def like_fallback(spark, sf_dir):
    return fulltext.like_fallback(table(spark, sf_dir, "documents"), "text", 'TOKEN = "').select("doc_id")


@query(f"SELECT doc_id, round(1 / (1 + abs(rank)), 5) AS text_score FROM ({fts_sql('the anea')})")
def rank_to_score(spark, sf_dir):
    return _fts("the anea")(spark, sf_dir).select("doc_id", F.round(fulltext.rank_to_score(F.col("rank")), 5).alias("text_score"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents)
SELECT term, doc_id, count(*) AS tf FROM w GROUP BY term, doc_id""")
def fts_postings(spark, sf_dir):
    return fulltext.postings(table(spark, sf_dir, "documents"), ("text",), key="doc_id").select("term", "doc_id", "tf")


# The same searches by the stored index: built once for a session and a folder, then read by each search.

_INDEXES: dict[tuple[str, str], inverted.Index] = {}


def _document_index(spark, sf_dir) -> inverted.Index:
    known = spark.sparkContext.applicationId, sf_dir
    if known not in _INDEXES:
        _INDEXES[known] = inverted.build(table(spark, sf_dir, "documents"), ("text", "source"), shared.new_path(spark, "fulltext"), key="doc_id")
    return _INDEXES[known]


def _bm25_sql(counts: list[str], matching: str, ranked: list[int]) -> str:
    """Rows by BM25; counts, the condition over tf_0, tf_1 ..., and the counts that the rank takes are written by hand for each query."""
    tf = ", ".join(f"{c} AS tf_{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) FILTER (WHERE tf_{i} > 0) AS df_{i}" for i in range(len(counts)))
    rank = " + ".join(f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 0.000001) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * doc_len / mean_len))" for i in ranked)
    return f"""
WITH w AS (SELECT doc_id, {_TOKENS.format("text")} AS x, {_TOKENS.format("source")} AS y FROM documents),
c AS (SELECT doc_id, len(x) + len(y) AS doc_len, {tf} FROM w),
t AS (SELECT count(*) AS n, avg(doc_len) AS mean_len, {df} FROM c)
SELECT doc_id, round(-({rank}), 6) AS rank FROM c, t WHERE {matching}"""


def _word_sql(word: str) -> str:
    return f"len(list_filter(x || y, lambda w: w = '{word}'))"


#: Name: query, SQL of its counts, condition, and the counts that are ranked.
INDEXED = {
    "index_and": ("the anea", [_word_sql("the"), _word_sql("anea")], "tf_0 > 0 AND tf_1 > 0", [0, 1]),
    "index_or": ("wh OR schch", [_word_sql("wh"), _word_sql("schch")], "tf_0 > 0 OR tf_1 > 0", [0, 1]),
    "index_not": ("anea NOT wh", [_word_sql("anea"), _word_sql("wh")], "tf_0 > 0 AND NOT tf_1 > 0", [0]),
    "index_prefix": ("undsch*", ["len(list_filter(x || y, lambda w: starts_with(w, 'undsch')))"], "tf_0 > 0", [0]),
    "index_column": ("source:src1 the", ["len(list_filter(y, lambda w: w = 'src1'))", _word_sql("the")], "tf_0 > 0 AND tf_1 > 0", [0, 1]),
    "index_phrase": ('"of the" OR "and of th"*', ["len(list_filter(range(1, len(x)), lambda i: x[i] = 'of' AND x[i + 1] = 'the'))", "len(list_filter(range(1, len(x) - 1), lambda i: x[i] = 'and' AND x[i + 1] = 'of' AND starts_with(x[i + 2], 'th')))"], "tf_0 > 0 OR tf_1 > 0", [0, 1]),
}


def _by_index(q: str):
    def run(spark, sf_dir):
        index = _document_index(spark, sf_dir)
        found = inverted.match(index, q).join(index.table("documents").select("number", F.col("key").alias("doc_id")), "number")
        return found.select("doc_id", F.round("rank", 6).alias("rank"))

    return run


for _name, (_q, *_rest) in INDEXED.items():
    QUERIES[_name], ORACLE_SQL[_name] = _by_index(_q), _bm25_sql(*_rest)


@query(f"SELECT doc_id, rank FROM ({_bm25_sql(*INDEXED['index_and'][1:])}) ORDER BY rank, doc_id LIMIT 20")
def index_top(spark, sf_dir):
    return inverted.search(_document_index(spark, sf_dir), "the anea", 20, decimals=6).select("doc_id", "rank")


@query(f"SELECT doc_id, round(1 / (1 + abs(rank)), 5) AS text_score FROM ({_bm25_sql(*INDEXED['index_and'][1:])})")
def rank_to_score_all(spark, sf_dir):
    found = fulltext.match(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ("text", "source"), "the anea")
    return found.select("doc_id", F.round(fulltext.rank_to_score(F.round("rank", 6)), 5).alias("text_score"))


@query("""
SELECT 'posting_without_row' AS code, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'row_without_posting', CAST(doc_id AS VARCHAR) FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def index_orphans(spark, sf_dir):
    return inverted.orphans(_document_index(spark, sf_dir), table(spark, sf_dir, "labels"))


@query(f"""
WITH w AS (SELECT 'text' AS column_name, {_TOKENS.format("text")} AS x FROM documents UNION ALL SELECT 'source', {_TOKENS.format("source")} FROM documents)
SELECT column_name, count(*) FILTER (WHERE len(x) > 0) AS documents, CAST(sum(len(x)) AS BIGINT) AS words, count(DISTINCT u) AS terms
FROM (SELECT column_name, x, NULL AS u FROM w UNION ALL SELECT column_name, [], unnest(x) FROM w) GROUP BY column_name""")
def index_counts(spark, sf_dir):
    return inverted.row_counts(_document_index(spark, sf_dir))


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents by text and vectors by similarity, as hits; doc_id pairs with vec_id."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("symbol_name"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("readme_section").alias("chunk_type"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("src/"), F.col("vec_id").cast("string")).alias("file_path"), F.lit("").alias("symbol_name"), F.lit("readme_section").alias("chunk_type"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.col("embedding").alias("vector"))
    by_text = search.text_hits(chunks, "anea", 30).withColumn("combined_score", F.round("combined_score", 5)).withColumn("text_score", F.round("text_score", 5))
    by_vector = search.semantic_hits(vecs, _probe(spark, sf_dir)).withColumn("combined_score", F.round("combined_score", 5)).withColumn("semantic_score", F.round("semantic_score", 5))
    return by_text, by_vector


def _hybrid_sql() -> str:
    tokens = {"content": "text", "symbol_name": "source", "file_path": "source || '/' || doc_id"}
    lens = " + ".join(f"len({_TOKENS.format(v)})" for v in tokens.values())
    tf = " + ".join(f"len(list_filter({_TOKENS.format(v)}, lambda w: w = 'anea'))" for v in tokens.values())
    return f"""
WITH c AS (SELECT doc_id, {lens} AS doc_len, {tf} AS tf FROM documents),
t AS (SELECT count(*) AS n, avg(doc_len) AS mean_len, count(*) FILTER (WHERE tf > 0) AS df FROM c),
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, -(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))) AS rank FROM c, t WHERE tf > 0),
x AS (SELECT id, round(1 / (1 + abs(rank)), 5) AS text_score FROM r ORDER BY rank, id LIMIT 30),
{_SCORES.replace(", 6)", ", 5)")},
y AS (SELECT CAST(vec_id AS VARCHAR) AS id, score AS semantic_score FROM (SELECT vec_id, score FROM (SELECT vec_id, greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.v))) AS raw, round(raw, 5) AS score FROM embeddings, q) ORDER BY raw DESC, CAST(vec_id AS VARCHAR) LIMIT 50))
SELECT coalesce(x.id, y.id) AS chunk_id, text_score, semantic_score, greatest(coalesce(text_score, 0), coalesce(semantic_score, 0)) AS combined_score,
  CASE WHEN x.id IS NULL THEN 'semantic' WHEN y.id IS NULL THEN 'text' ELSE 'both' END AS match_source
FROM x FULL JOIN y ON x.id = y.id ORDER BY combined_score DESC, chunk_id LIMIT 40"""


@query(_hybrid_sql())
def hybrid_merge(spark, sf_dir):
    return search.merged(*_hits(spark, sf_dir), 40).select("chunk_id", "text_score", "semantic_score", "combined_score", "match_source")


# Parts as symbols, pages as routes.


def part_symbols(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("file_id"), F.lit("function").alias("symbol_type"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_partkey").cast("int").alias("start_line"), (F.col("p_partkey") + F.col("p_size")).cast("int").alias("end_line"), F.lit(None).cast("string").alias("parent_symbol_id"))
    files = p.select(F.col("p_type").alias("id"), F.concat(F.lit("lib/"), F.col("p_type")).alias("path")).distinct()
    return symbols, files


_SYMBOL = "CAST(p_partkey AS VARCHAR) AS semantic_key, p_brand || '.' || p_name AS qualified_name, 'lib/' || p_type AS source_path, CAST(p_partkey AS INTEGER) AS start_line, CAST(p_partkey + p_size AS INTEGER) AS end_line"
_FIRST_PART = "(SELECT p_name FROM part ORDER BY p_partkey LIMIT 1)"


def _first_part(spark, sf_dir) -> str:
    return table(spark, sf_dir, "part").orderBy("p_partkey").first()["p_name"]


@query(f"SELECT {_SYMBOL} FROM part WHERE p_name = {_FIRST_PART} OR p_brand || '.' || p_name = {_FIRST_PART} ORDER BY start_line, semantic_key LIMIT 20")
def symbols_exact(spark, sf_dir):
    return lookup.find_symbols(*part_symbols(spark, sf_dir), _first_part(spark, sf_dir), 20, exact=True).select("semantic_key", "qualified_name", "source_path", "start_line", "end_line")


@query(f"""
SELECT {_SYMBOL} FROM part WHERE p_name ILIKE '%l_b%' OR p_brand || '.' || p_name ILIKE '%l_b%' OR 'lib/' || p_type ILIKE '%l_b%' ORDER BY start_line, semantic_key LIMIT 50""")
def symbols_partial(spark, sf_dir):
    return lookup.find_symbols(*part_symbols(spark, sf_dir), "L_b", 50).select("semantic_key", "qualified_name", "source_path", "start_line", "end_line")


_ROUTE_NAME = "'GET ' || regexp_extract(url, '^[^:]*://[^/]*([^?#]*)', 1)"


@query(f"""
SELECT 'GET' AS http_method, substr({_ROUTE_NAME}, 5) AS route_path, regexp_extract(url, '://([^/]*)', 1) AS handler_semantic_key, regexp_extract(regexp_extract(url, '://([^/]*)', 1), '([^.]*)$', 1) AS handler_name, CAST(page_id AS INTEGER) AS decorator_line
FROM pages WHERE {_ROUTE_NAME} LIKE '%/en/%' AND regexp_extract(url, '://([^/]*)', 1) ILIKE '%example%' ORDER BY page_id LIMIT 100""")
def routes_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    symbols = p.select(F.col("page_id").cast("string").alias("id"), F.lit("f").alias("file_id"), F.lit("route").alias("symbol_type"), F.concat(F.lit("GET "), F.regexp_extract("url", "^[^:]*://[^/]*([^?#]*)", 1)).alias("name"), F.regexp_extract("url", "://([^/]*)", 1).alias("qualified_name"), F.col("page_id").cast("int").alias("start_line"), F.col("page_id").cast("int").alias("end_line"))
    files = spark.createDataFrame([("f", "site.py")], "id string, path string")
    return lookup.find_routes(symbols, files, "get", "/en/", "EXAMPLE", 100).select("http_method", "route_path", "handler_semantic_key", "handler_name", "decorator_line")


@query(f"""
SELECT 'code' AS kind, CAST(doc_id AS VARCHAR) AS key FROM ({fts_sql("anea", 10)})
UNION ALL SELECT 'symbol', CAST(p_partkey AS VARCHAR) FROM (SELECT p_partkey FROM part WHERE p_name ILIKE '%widget%' OR p_brand || '.' || p_name ILIKE '%widget%' OR 'lib/' || p_type ILIKE '%widget%' ORDER BY CAST(p_partkey AS INTEGER), CAST(p_partkey AS VARCHAR) LIMIT 10)""")
def existing_implementation(spark, sf_dir):
    code = _fts("anea")(spark, sf_dir).orderBy("rank", "doc_id").limit(10).select(F.lit("code").alias("kind"), F.col("doc_id").cast("string").alias("key"))
    found = lookup.find_symbols(*part_symbols(spark, sf_dir), "widget", 10).select(F.lit("symbol").alias("kind"), F.col("semantic_key").alias("key"))
    return code.unionByName(found)


# The graph.


def raw_nodes(spark, sf_dir) -> DataFrame:
    """Nodes before repetitions go: nations come once more from their customers."""
    t = lambda n: table(spark, sf_dir, n)

    def of(df, kind, key, label, node_type, order):
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.lit(node_type).alias("node_type"), label.alias("label"), F.lit(kind).alias("source_file"), F.col(key).cast("string").alias("source_location"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("metadata"), F.lit(order).alias("kind"), F.col(key).cast("long").alias("seq"))

    parts = [of(t("region"), "region", "r_regionkey", F.col("r_name"), "file", 0), of(t("nation"), "nation", "n_nationkey", F.col("n_name"), "class", 1), of(t("customer"), "customer", "c_custkey", F.col("c_name"), "function", 2), of(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), "method", 3), of(t("customer"), "nation", "c_nationkey", F.lit("again"), "class", 4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def edge(df, source, target, relation, confidence):
        return df.select(source.alias("source_node_id"), target.alias("target_node_id"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit("").alias("source_file"), source.alias("source_location"), F.lit(None).cast("string").alias("metadata"))

    out = edge(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "defines", "EXTRACTED")
    out = out.unionByName(edge(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "defines", "EXTRACTED"))
    out = out.unionByName(edge(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "defines", "EXTRACTED"))
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.unionByName(edge(bought, key("customer", "o_custkey"), key("supplier", "l_suppkey"), "calls", "INFERRED"))


def the_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return graph.distinct_nodes(raw_nodes(spark, sf_dir)), graph.distinct_edges(raw_edges(spark, sf_dir))


_NODES = """
raw_n AS (
  SELECT 'region:' || r_regionkey AS node_id, 'file' AS node_type, r_name AS label, 'region' AS source_file FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'class', n_name, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'function', c_name, 'customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'method', s_name, 'supplier' FROM supplier),
n AS (SELECT 'gn:' || sha256('{"kind":"node","node_id":"' || node_id || '","node_type":"' || node_type || '","schema":"wp5.step3.graph.v1"}') AS id, * FROM raw_n)"""
_EDGES = """
raw_e AS (
  SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t, 'defines' AS relation, 'EXTRACTED' AS confidence FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'defines', 'EXTRACTED' FROM customer
  UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'defines', 'EXTRACTED' FROM supplier
  UNION SELECT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls', 'INFERRED' FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT 'ge:' || sha256('{"kind":"edge","relation":"' || relation || '","schema":"wp5.step3.graph.v1","source_file":"","source_location":"' || s || '","source_node_id":"' || s || '","target_node_id":"' || t || '"}') AS id, * FROM raw_e)"""


@query(f"WITH {_NODES} SELECT id, node_id, node_type, label, source_file FROM n")
def graph_nodes_distinct(spark, sf_dir):
    return the_graph(spark, sf_dir)[0].select("id", "node_id", "node_type", "label", "source_file")


@query(f"WITH {_EDGES} SELECT id, s AS source_node_id, t AS target_node_id, relation, confidence FROM e")
def graph_edges_distinct(spark, sf_dir):
    return the_graph(spark, sf_dir)[1].select("id", "source_node_id", "target_node_id", "relation", "confidence")


def _related(direction: str, limit: int = 200):
    def run(spark, sf_dir):
        nodes, edges = the_graph(spark, sf_dir)
        return lookup.related(edges, nodes, "nation:7", direction, None, limit).drop("center_identity")

    return run


def _related_sql(directions: list[str], limit: int = 200) -> str:
    sides = {"outgoing": ("s", "t", 0), "incoming": ("t", "s", 1)}
    parts = [f"SELECT {k} AS side, n.node_id AS related_node_identity, n.node_type AS node_kind, n.label AS qualified_name, n.source_file AS source_path, e.relation AS relationship_type, '{d}' AS direction, e.confidence AS qualifier, e.id AS edge_id FROM e JOIN n ON n.node_id = e.{b} WHERE e.{a} = 'nation:7'" for d in directions for a, b, k in [sides[d]]]
    return f"WITH {_NODES}, {_EDGES} SELECT related_node_identity, node_kind, qualified_name, source_path, relationship_type, direction, qualifier FROM ({' UNION ALL '.join(parts)}) ORDER BY side, relationship_type, related_node_identity, edge_id LIMIT {limit}"


for _name, _sides, _most in (("related_outgoing", ["outgoing"], 200), ("related_incoming", ["incoming"], 200), ("related_both", ["outgoing", "incoming"], 30)):
    QUERIES[_name] = _related(_sides[0] if len(_sides) == 1 else "both", _most)
    ORACLE_SQL[_name] = _related_sql(_sides, _most)

_IMPACT = [("direct_callees", "s", "t", "calls", ""), ("direct_callers", "t", "s", "calls", ""), ("containing_class", "t", "s", "defines", "AND n.node_type = 'class'"), ("containing_file", "t", "s", "defines", "AND n.node_type = 'file'")]


@query(f"WITH {_NODES}, {_EDGES} " + " UNION ALL ".join(f"SELECT '{c}' AS category, n.id AS record_id, n.label AS qualified_name FROM e JOIN n ON n.node_id = e.{b} WHERE e.{a} = 'customer:1' AND e.relation = '{r}' {more}" for c, a, b, r, more in _IMPACT))
def impact_first_order(spark, sf_dir):
    nodes, edges = the_graph(spark, sf_dir)
    return lookup.impact(edges, nodes, "customer:1", 500).select("category", "record_id", "qualified_name")


@query(f"WITH {_NODES}, {_EDGES}, one AS (SELECT DISTINCT t FROM e WHERE s = 'region:1'), two AS (SELECT DISTINCT e.t FROM e JOIN one ON e.s = one.t) SELECT t AS node_id, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT t, 1 AS hops FROM one UNION ALL SELECT t, 2 FROM two) GROUP BY t")
def two_hop_reachability(spark, sf_dir):
    return graph.reachable(the_graph(spark, sf_dir)[1], "region:1", 2)


def _reach_sql(step: str, start: str) -> str:
    return f"""
WITH RECURSIVE {_EDGES}, l AS (SELECT DISTINCT {step} FROM e),
r(node_id, hops) AS (SELECT '{start}', 0 UNION SELECT l.b, r.hops + 1 FROM r JOIN l ON l.a = r.node_id WHERE r.hops < 3),
f AS (SELECT node_id, min(hops) AS hops FROM r GROUP BY node_id),
p AS (SELECT f.node_id, f.hops, min(g.node_id) AS previous FROM f LEFT JOIN l ON l.b = f.node_id LEFT JOIN f g ON g.node_id = l.a AND g.hops = f.hops - 1 GROUP BY f.node_id, f.hops),
w(node_id, up, path) AS (SELECT node_id, previous, node_id FROM p UNION ALL SELECT w.node_id, p.previous, p.node_id || '>' || w.path FROM w JOIN p ON p.node_id = w.up)
SELECT p.node_id, CAST(p.hops AS INTEGER) AS hops, p.previous, w.path FROM p JOIN w ON w.node_id = p.node_id AND w.up IS NULL"""


def _reach(spark, sf_dir, direction: str, start: str) -> DataFrame:
    edges = raw_edges(spark, sf_dir)  # links tells repetitions apart itself
    found = paths.reach(paths.links(edges, direction), spark.createDataFrame([(start,)], "node_id string"), 3)
    return found.select("node_id", "hops", "previous", F.array_join("path", ">").alias("path"))


@query(_reach_sql("s AS a, t AS b", "region:1"))
def reach_outgoing(spark, sf_dir):
    return _reach(spark, sf_dir, "outgoing", "region:1")


@query(_reach_sql("t AS a, s AS b", "supplier:1"))
def reach_incoming(spark, sf_dir):
    return _reach(spark, sf_dir, "incoming", "supplier:1")


@query(f"""
WITH {_SCORES.replace("SELECT vec_id, round", "SELECT vec_id, label, round")},
g AS (SELECT *, CASE WHEN round(lag(score) OVER (ORDER BY score DESC) - score, 9) > 0.02 THEN 1 ELSE 0 END AS opens FROM s),
b AS (SELECT vec_id, label, score, 1 + sum(opens) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS band FROM g)
SELECT vec_id, label, score, CAST(band AS BIGINT) AS band FROM b""")
def score_bands(spark, sf_dir):
    q = F.array(*map(F.lit, _probe(spark, sf_dir)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(vectors.clamped(vectors.cosine(F.col("embedding"), q)), 6).alias("score"))
    return bands.ranked(e, "score", [F.col("label"), F.col("vec_id")])


# Names resolved to symbols.


def _named(df: DataFrame, key: str, name: Column, kind: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("node_id"), name.alias("name"), F.lit(kind).alias("symbol_type"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CAST(c_custkey AS VARCHAR) AS target_id FROM orders JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AND c_custkey <> o_orderkey")
def calls_resolution(spark, sf_dir):
    targets = _named(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), "function")
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("callee"))
    return graph.by_name(sources, "callee", targets, ("function", "method")).where("source_id <> target_id").select("source_id", "target_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS source_id, CAST(n_nationkey AS VARCHAR) AS target_id FROM supplier JOIN nation b ON b.n_nationkey = s_nationkey")
def inherits_resolution(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    sources = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("source_id"), F.explode(F.array("n_name")).alias("base"))
    return graph.by_name(sources, "base", _named(nations, "n_nationkey", F.col("n_name"), "class"), ("class",)).select("source_id", "target_id")


@query("SELECT a.p_partkey AS source_id, CAST(b.p_partkey AS VARCHAR) AS target_id FROM part a JOIN part b ON substr('test_' || a.p_name, 6) = b.p_name")
def tests_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sources = p.select(F.col("p_partkey").alias("source_id"), F.concat(F.lit("test_"), F.col("p_name")).alias("name")).withColumn("tested", F.expr("substring(name, 6)")).drop("name")
    return graph.by_name(sources, "tested", _named(p, "p_partkey", F.col("p_name"), "function"), ("function", "method", "class"), shared=True).select("source_id", "target_id")


@query("""
WITH one AS (SELECT p_brand, p_type, min(p_partkey) AS class_id FROM part WHERE p_size > 40 GROUP BY p_brand, p_type HAVING count(*) = 1)
SELECT CAST(p.p_partkey AS VARCHAR) AS symbol_id, CAST(o.class_id AS VARCHAR) AS class_id FROM part p JOIN one o ON p.p_brand = o.p_brand AND p.p_type = o.p_type WHERE p.p_size <= 40""")
def parent_edges_unique(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_brand").alias("path"), F.when(F.col("p_size") > 40, "class").otherwise("method").alias("symbol_type"), F.col("p_type").alias("name"), F.col("p_type").alias("parent"))
    return graph.parents(symbols).select("symbol_id", "class_id")


@query("""
SELECT o_orderkey AS route_id, arg_min(l_partkey, l_partkey * 10 + l_linenumber) AS handler_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey""")
def route_handler_first(spark, sf_dir):
    symbols = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("name"), F.lit("function").alias("symbol_type"), F.col("l_partkey").alias("symbol_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    routes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit("R").alias("handler_function"), F.col("o_orderkey").alias("route_id"))
    return graph.first_handlers(routes, symbols).select("route_id", "handler_id")


# Counts and constraints.


@query("""
SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM labels WHERE quality = 1) AS parsed, (SELECT count(*) FROM labels WHERE quality = 0) AS errors,
  (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL) AS not_applicable, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM pages) AS routes, (SELECT coalesce(CAST(sum(len(embedding)) AS BIGINT), 0) FROM embeddings) AS vectors""")
def repository_summary(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    status = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    files = status.agg(F.countDistinct("doc_id").alias("files"), F.count_if(F.col("quality") == 1).alias("parsed"), F.count_if(F.col("quality") == 0).alias("errors"), F.count_if(F.col("quality").isNull()).alias("not_applicable"))
    one = lambda n, e, name: t(n).agg(e.alias(name))
    return files.crossJoin(one("part", F.count(F.lit(1)), "symbols")).crossJoin(one("pages", F.count(F.lit(1)), "routes")).crossJoin(one("embeddings", F.coalesce(F.sum(F.size("embedding")), F.lit(0)).cast("long"), "vectors"))


@query("""
SELECT 'order_without_customer' AS code, CAST(k AS VARCHAR) AS key FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
UNION ALL SELECT 'item_without_order', CAST(k AS VARCHAR) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'))""")
def fk_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    a = validate.orphans(t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey", "order_without_customer")
    return a.unionByName(validate.orphans(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus <> 'F'"), "o_orderkey", "item_without_order"))


@query("""
WITH d AS (SELECT doc_id AS id FROM documents), v AS (SELECT vec_id AS id FROM embeddings)
SELECT 'ids_only_first' AS code, CAST(id AS VARCHAR) AS key FROM (SELECT id FROM d EXCEPT SELECT id FROM v)
UNION ALL SELECT 'ids_only_second', CAST(id AS VARCHAR) FROM (SELECT id FROM v EXCEPT SELECT id FROM d)""")
def set_equality(spark, sf_dir):
    return validate.differing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "ids")


@query("""
SELECT 'missing_source_node_id' AS code, CAST(k AS VARCHAR) AS key FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'duplicate_node', CAST(c_nationkey AS VARCHAR) FROM (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1)""")
def endpoint_integrity(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lost = validate.orphans(table(spark, sf_dir, "orders"), "o_custkey", c.where("c_mktsegment <> 'BUILDING'"), "c_custkey", "missing_source_node_id")
    return lost.unionByName(validate.repeated(c, "c_nationkey", "duplicate_node"))


@query("""
SELECT code, key FROM (
  SELECT 'blank_content' AS code, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE text = ''
  UNION ALL SELECT 'bad_language', CAST(doc_id AS VARCHAR) FROM documents WHERE lang NOT IN ('en', 'de')
  UNION ALL SELECT 'long_content', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars > 10000
  UNION ALL SELECT 'bad_length', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars <> length(text)
  UNION ALL SELECT 'duplicate_text', h FROM (SELECT sha256(text) AS h FROM documents GROUP BY h HAVING count(*) > 1))""")
def validate_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = validate.broken(d, "doc_id", blank_content=F.col("text") == "", bad_language=~F.col("lang").isin("en", "de"), long_content=F.col("n_chars") > 10000, bad_length=F.col("n_chars") != F.char_length("text"))
    return rows.unionByName(validate.repeated(d.select(F.sha2("text", 256).alias("h")), "h", "duplicate_text"))


# Extensions.


@query("SELECT source AS folder, count(*) AS n_files FROM documents GROUP BY source")
def folder_counts(spark, sf_dir):
    return extensions.folders(doc_files(spark, sf_dir))


@query(f"WITH {_EDGES}, d AS (SELECT s AS node_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT t, 1, 0 FROM e) SELECT node_id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, count(*) AS degree FROM d GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 25")
def most_connected(spark, sf_dir):
    return extensions.most_connected(graph.distinct_edges(raw_edges(spark, sf_dir)), 25)


@query("""
SELECT p_name || '#' || p_partkey AS path, count(*) AS n_symbols, round(count(*) / (SELECT count(*)::DOUBLE FROM lineitem), 4) AS share
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n_symbols DESC, path LIMIT 20""")
def files_with_most_symbols(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("path"))
    return extensions.files_with_most_symbols(table(spark, sf_dir, "lineitem"), parts, 20, key="l_partkey", file_key="p_partkey")


@query(f"WITH {_EDGES} SELECT t AS node_id, CASE WHEN count(*) >= 6 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM e WHERE relation = 'calls' GROUP BY t")
def risk_levels(spark, sf_dir):
    callers = graph.distinct_edges(raw_edges(spark, sf_dir)).where("relation = 'calls'").groupBy(F.col("target_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return callers.select("node_id", extensions.risk_level(F.col("n")).alias("risk"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id, CASE WHEN contains({_LOW}, 'of the') THEN 1.0 WHEN contains({_LOW}, 'of') AND contains({_LOW}, 'the') THEN 0.7 WHEN contains({_LOW}, 'of') OR contains({_LOW}, 'the') THEN 0.4 ELSE 0.0 END::DOUBLE AS score FROM documents")
def keyword_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extensions.keyword_score(F.col("text"), "of the").alias("score"))


# Python sources made of the documents. The text of a module is generated, so that what parsing must give can be said in SQL.


def _sources(spark, sf_dir) -> DataFrame:
    """A module for each document: a function for each of its lines, with the line's words in it, a route, a test, and a class for each distinct word.

    Names of functions carry the document and the line. A line calls the next one and the last line the next document's first, so that
    links between modules grow with their number.
    """
    nr, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != "")))
    # Documents are dealt out for the parser, since modules are larger; out of a generator, so that a text is not split anew for each of its lines.
    docs = doc_files(spark, sf_dir).select("doc_id", "path", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", "path", F.inline(F.array(F.struct(lines.alias("lines"), words.alias("words")))))
    lines, words = F.col("lines"), F.when(F.size("words") == 0, F.array(F.lit("empty"))).otherwise(F.col("words"))

    def block(line: Column, i: Column) -> Column:
        said = F.regexp_replace(line, r"[^\p{L}\p{N} ]+", " ")
        to = F.when(i + 1 < F.size(lines), F.concat(nr, F.lit("_"), (i + 1).cast("string"))).otherwise(F.concat(after, F.lit("_0")))
        return F.concat(F.lit("def line_"), nr, F.lit("_"), i.cast("string"), F.lit('(text):\n    words = "'), said, F.lit('"\n    return line_'), to, F.lit("(words)\n"))

    def named(word: Column, i: Column) -> Column:
        return F.concat(F.lit("class C"), word, F.when(i == 0, F.concat(F.lit(":\n    def run(self):\n        return line_"), nr, F.lit("_0(self)"))).otherwise(": pass"))

    tail = F.concat(F.lit('@app.get("/doc/'), nr, F.lit('")\ndef show_'), nr, F.lit("():\n    return line_"), nr, F.lit('_0("")\n\ndef test_line_'), nr, F.lit("_0():\n    assert line_"), nr, F.lit('_0("")\n'))
    body = F.concat(F.lit("import os\n\n"), F.array_join(F.transform(lines, block), "\n"), F.lit("\n"), tail, F.array_join(F.transform(words, named), "\n"), F.lit("\n"))
    return docs.select(F.regexp_replace("path", "md$", "py").alias("path"), body.alias("text"), F.lit(False).alias("is_binary"), F.lit("pending").alias("parse_status"), F.lit("source").alias("file_type"))


_MODULES = """WITH w AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> ''))) AS found FROM documents),
m AS (SELECT doc_id, source || '/doc_' || doc_id || '.py' AS path, len(string_split(coalesce(text, ''), chr(10))) AS n, CASE WHEN len(found) = 0 THEN ['empty'] ELSE found END AS words FROM w),
l AS (SELECT *, unnest(range(n)) AS i FROM m), t AS (SELECT *, 3 + 4 * n AS z FROM m), k AS (SELECT path, z, unnest(words) AS word, unnest(range(len(words))) AS j FROM t)"""


@query(f"""
{_MODULES},
s(path, symbol_type, name, qualified_name, signature, start_line, end_line) AS (
  SELECT path, 'function', 'line_' || doc_id || '_' || i, 'line_' || doc_id || '_' || i, '(text)', 3 + 4 * i, 5 + 4 * i FROM l
  UNION ALL SELECT path, 'variable', 'words', 'words', NULL, 4 + 4 * i, 4 + 4 * i FROM l
  UNION ALL SELECT path, 'function', 'show_' || doc_id, 'show_' || doc_id, '()', z + 1, z + 2 FROM t
  UNION ALL SELECT path, 'route', 'GET /doc/' || doc_id, 'show_' || doc_id, '()', z, z + 2 FROM t
  UNION ALL SELECT path, 'function', 'test_line_' || doc_id || '_0', 'test_line_' || doc_id || '_0', '()', z + 4, z + 5 FROM t
  UNION ALL SELECT path, 'method', 'run', 'C' || words[1] || '.run', '(self)', z + 7, z + 8 FROM t
  UNION ALL SELECT path, 'class', 'C' || word, 'C' || word, NULL, CASE WHEN j = 0 THEN z + 6 ELSE z + 8 + j END, z + 8 + j FROM k)
SELECT path, symbol_type, name, qualified_name, signature, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
  CASE WHEN symbol_type = 'route' THEN 'route:GET:' || substr(name, 5) || ':' || path || ':' || start_line ELSE symbol_type || ':' || path || ':' || name || ':' || start_line END AS symbol_id
FROM s""")
def parse_python_symbols(spark, sf_dir):
    return parse.parse_symbols(_sources(spark, sf_dir), dealt=True).select("path", "symbol_type", "name", "qualified_name", "signature", "start_line", "end_line", "symbol_id")


@query(f"""
{_MODULES}, e(relation, n) AS (
  SELECT 'defines', sum(n + 5 + len(words)) FROM m UNION ALL SELECT 'handles_route', count(*) FROM m UNION ALL SELECT 'imports', count(*) FROM m UNION ALL SELECT 'tests', count(*) FROM m
  UNION ALL SELECT 'calls', sum(n + 2 + CASE WHEN doc_id + 1 IN (SELECT doc_id FROM documents) THEN 1 ELSE 0 END) FROM m)
SELECT relation, CAST(n AS BIGINT) AS n FROM e WHERE n > 0""")
def graph_of_sources(spark, sf_dir):
    path, kind = shared.new_path(spark, "parsed"), F.coalesce("symbols.symbol_type", F.when(F.col("imports").isNotNull(), "import").otherwise("declared"))
    schema = _store_items(spark, sf_dir, path, kind)
    shared.sweep(spark)  # the shuffle of the documents
    stored = spark.read.schema(schema).parquet(path)
    symbols = stored.where("kind not in ('import', 'declared')").select("path", "file_type", F.col("kind").alias("symbol_type"), F.col("symbols").dropFields("symbol_type").alias("s")).select("path", "file_type", "symbol_type", "s.*")
    imports, routes = stored.where("kind = 'import'").select("path", "imports.*"), stored.where("kind = 'declared'").select("path", "routes.*")
    return graph.edges(routes.select("path"), symbols, imports, routes).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def _store_items(spark, sf_dir, path: str, kind: Column) -> T.StructType:
    """Writes the modules' items in folders by kind, without what the graph doesn't use: variables, which have no node, and fields of symbols.

    They feed many joins. A cached table would carry the plan that makes the sources into each of them, and every stage sends the driver the plan
    anew; lists by file would have to be unnested, and joined with the files' types, for each of them.
    """
    rows = parse.items(parse.parse(_sources(spark, sf_dir), "file_type", dealt=True).drop("status", "error"))
    rows = rows.withColumn("kind", kind).where("kind <> 'variable'").withColumn("symbols", F.col("symbols").dropFields("qualified_name", "signature", "docstring", "end_line", "confidence"))
    rows.write.partitionBy("kind").parquet(path, compression="zstd")
    return rows.schema
