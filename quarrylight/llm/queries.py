"""The queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe_codec, byte_fold, cross_tokens, decontamination, line_dedup, minhash_dedup, prefix_trie, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filters, warc
from quarrylight.llm.runtime import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.near_passages(table(spark, sf_dir, "documents"), least=50, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=512)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_copies(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=10, min_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules of op6: (host, path, action).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules, default="allow")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_pages(table(spark, sf_dir, "pages"), least_bytes=1000)
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_fold.encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_minhash_dedup, op4_line_dedup, op5_quality_rules, op6_url_filters, op7_decontamination, op8_bpe_codec, op9_warc, op10_suffix_dedup, op11_prefix_trie, op12_cross_tokens, op13_byte_bpe)}

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _ASCII_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

#: Votes of op5's rules, in their order.
_VOTES = """CASE WHEN 10 * n_symbols > n THEN -1 ELSE 0 END, CASE WHEN 5 * n_repeat_words > n THEN -1 ELSE 0 END, CASE WHEN 3 * n_dup_lines > nl THEN -1 ELSE 0 END,
  CASE WHEN n >= 20 AND 4 * n_distinct < n THEN -1 ELSE 0 END, CASE WHEN 10 * n_capitals > 4 * c THEN -1 ELSE 0 END, CASE WHEN 10 * n_bangs > n THEN -1 ELSE 0 END,
  CASE WHEN c < 2 * n OR c > 12 * n THEN -1 WHEN c >= 3 * n AND 10 * c <= 75 * n THEN 1 ELSE 0 END, CASE WHEN 10 * n_ends < 3 * nl THEN -1 WHEN 10 * n_ends >= 8 * nl THEN 1 ELSE 0 END"""
_P_GOOD = """1 / (1 + exp(-(ln(em.s / (1 - em.s)) + list_sum(list_transform(range(1, 9), lambda k: CASE {v}[k] WHEN 1 THEN ln(em.gp[k] / em.bp[k]) WHEN -1 THEN ln(em.gn[k] / em.bn[k])
  ELSE ln((1 - em.gp[k] - em.gn[k]) / (1 - em.bp[k] - em.bn[k])) END)))))"""


def _em_rate(name: str, vote: int, of: str) -> str:
    start, prior = quality_rules.START[name], quality_rules.PRIOR
    return f"list_transform(range(1, 9), lambda k: (list_sum(list_transform(q, lambda x: CASE WHEN x.v[k] = {vote} THEN x.n * {of} ELSE 0.0::DOUBLE END)) + {start}::DOUBLE * {prior}) / (list_sum(list_transform(q, lambda x: x.n * {of})) + {prior}))"


ORACLE_SQL = {
    "op5_quality_rules": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
places AS (SELECT win.doc_id, i, lead(i) OVER (PARTITION BY win.doc_id ORDER BY i) AS nx FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.g = twice.g),
again AS (SELECT doc_id, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n_repeat_words FROM places GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
    len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_bangs, len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '[.!?:;"”»)]\\z'))) AS n_ends,
    greatest(len(ws), 1) AS n, greatest(length(array_to_string(ws, '')), 1) AS c, greatest(len(ls), 1) AS nl
  FROM w LEFT JOIN again a ON a.doc_id = w.doc_id),
v AS (SELECT *, [{_VOTES}] AS v, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
pats AS (SELECT list(struct_pack(v := v, n := m) ORDER BY v) AS ps FROM (SELECT v, CAST(count(*) AS DOUBLE) AS m FROM v WHERE NOT base_failed GROUP BY v)),
em AS (
  SELECT 0 AS r, {", ".join(f"[{', '.join([f'{quality_rules.START[k]}::DOUBLE'] * 8)}] AS {k}" for k in ("gp", "gn", "bp", "bn"))}, {quality_rules.START["s"]}::DOUBLE AS s
  UNION ALL
  SELECT r + 1, {_em_rate("gp", 1, "x.p")}, {_em_rate("gn", -1, "x.p")}, {_em_rate("bp", 1, "(1 - x.p)")}, {_em_rate("bn", -1, "(1 - x.p)")},
    (list_sum(list_transform(q, lambda x: x.n * x.p)) + {quality_rules.START["s"]}::DOUBLE * {quality_rules.PRIOR}) / (list_sum(list_transform(q, lambda x: x.n)) + {quality_rules.PRIOR})
  FROM (SELECT r, list_transform(ps, lambda x: struct_pack(v := x.v, n := x.n, p := {_P_GOOD.format(v="x.v")})) AS q FROM em, pats WHERE r < {quality_rules.ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_P_GOOD.format(v="v.v")} >= 0.5 AS kept
FROM v, em WHERE em.r = {quality_rules.ROUNDS}""",
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_decontamination": f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n),
hits AS (
  SELECT w.doc_id, w.i, w.n, b.item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM dw) w JOIN bw b ON w.n = b.n AND w.g = b.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op10_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substr(hx, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, hx, unnest(range(0, n - 399)) AS i FROM h WHERE n >= 400)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
starts AS (SELECT w.doc_id, w.i FROM win w JOIN twice t ON w.k = t.k),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS opens FROM starts),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS u, a AS v FROM runs UNION ALL SELECT h.doc_id, coalesce(max(r.b), 0), h.n FROM h LEFT JOIN runs r ON r.doc_id = h.doc_id GROUP BY h.doc_id, h.n),
kept AS (SELECT g.doc_id, string_agg(substr(h.hx, 2 * u + 1, 2 * (v - u)), '' ORDER BY u) AS hx FROM gaps g JOIN h ON h.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce(sum(r.b - r.a), 0) AS BIGINT) AS n_removed, count(r.run) AS n_spans, sha256(unhex(k.hx)) AS kept_sha256
FROM h JOIN kept k ON k.doc_id = h.doc_id LEFT JOIN runs r ON r.doc_id = h.doc_id GROUP BY h.doc_id, h.n, k.hx""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN k.kept <> p.page_id AND p.payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.kept <> p.page_id AND p.payload_bytes >= 1000 THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest""",
    "op6_url_filters": f"""
WITH rules(host, path, action) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
urls AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, {_ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
fits AS (
  SELECT c.page_id, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT c.page_id, coalesce(c.host, '') AS host, coalesce(c.path, '') AS path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON c.page_id = f.page_id AND f.k = 1""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, n,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v // 2, 3988292384::BIGINT * (v % 2))))) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
own AS (
  SELECT c.conv_id, t.k AS d, r, x FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k - c.h + least(c.h, coalesce(b.n, 0)), r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT c.conv_id, coalesce(list(sha256(CAST(length(r) AS VARCHAR) || ':' || r || x) ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS path,
    coalesce(list(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS words
  FROM c LEFT JOIN own ON own.conv_id = c.conv_id GROUP BY c.conv_id),
o AS (SELECT conv_id, len(path) AS size, d, array_to_string(path[1:d], '') AS key, array_to_string(path[1:d - 1], '') AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (
  SELECT key, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, max(size) = d AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
  FROM o GROUP BY key, d),
under AS (
  SELECT a.key, count(*) FILTER (WHERE b.leaf) AS n_leaves, CAST(sum((b.n_convs - 1) * b.w) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE b.d = a.d + 1) AS n_children
  FROM n a JOIN n b ON b.d >= a.d AND starts_with(b.key, a.key) GROUP BY a.key)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, under.n_children, under.n_leaves, under.saved_tokens, n.ends_sha256
FROM n JOIN under ON under.key = n.key LEFT JOIN n u ON n.d > 0 AND u.key = n.up""",
}
