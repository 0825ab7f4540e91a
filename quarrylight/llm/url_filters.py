"""URL filters by a sort-merge range join, in DataFrame functions only.

A canonical key is a host with its labels reversed, then the path. A rule that fits its host and
all subdomains, if the path starts with the rule's, is the interval of keys that start with
the rule's key, once for each host that a URL lies under: a URL of a.b.c has a key under c, c.b and
c.b.a. Rules with one host nest or are disjoint, so a sweep in order of keys that remembers the
last rule opened on each level of nesting has the stack of active rules at every URL.

The sweep runs over distinct (host, path) pairs, dealt out by host. A host with many of them is dealt to as many
slots as its number of pairs asks for, each with that host's rules; no task holds all of a hot host.

Defined results: a null URL, or one without ://, has an empty host and an empty path, which no
rule fits; repeated and null ids give one result row each; rules with a null host are
ignored, a null path counts as empty; of repeated rules with equal host and path, block wins;
other columns of pages are not read; empty pages give an empty result and empty rules the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.runtime import col

#: (host, path) pairs of one host in one slot of the sweep, about.
SLOT = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is no ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_labels(host: Column) -> Column:
    """a.b.c as [c, b, a]."""
    return F.reverse(F.split(host, "\\."))


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages.

    `rules` has host, path and action (allow or block). Of the rules that fit, the one with the longest
    host wins, among these the one with the longest path; its text is host and path.
    """
    urls = pages.select(col(id_col).alias("page_id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    known = rules.where(F.col("host").isNotNull()).groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("action").alias("action"))
    known = known.withColumn("under", F.array_join(reversed_labels(F.col("host")), "."))

    # One key for each host that a URL lies under, where some rule has that host.
    pairs = urls.groupBy("host", "path").agg(F.lit(1).alias("one")).where("host <> ''")
    labels = pairs.select("host", "path", F.inline(F.array(F.struct(reversed_labels(F.col("host")).alias("labels")))))
    keys = labels.select("host", "path", F.explode(F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, 1, k), '.'))")).alias("under"))
    keys = keys.join(known.select("under").distinct(), "under", "left_semi")
    slots = keys.groupBy("under").agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("slots"))
    points = keys.join(slots, "under").select("under", F.expr("cast(pmod(xxhash64(host, path), slots) as int)").alias("slot"), F.col("path").alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast("string").alias("action"), F.lit(0).alias("depth"))
    marks = _nested(known).join(slots, "under").select("under", F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), F.col("path").alias("key"), F.lit(0).alias("kind"), "host", "action", "depth")

    # The sweep: at each key, the last rule opened on each level; those that the path still starts with are active.
    levels = (known.agg(F.max(F.length("path"))).first()[0] or 0) and (_nested(known).agg(F.max("depth")).first()[0] or 0)
    sweep = Window.partitionBy("under", "slot").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.struct(F.col("key").alias("path"), "host", "action")
    stack = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), opened), ignorenulls=True).over(sweep).alias(f"open{d}") for d in range(levels + 1)]
    swept = points.unionByName(marks).select("*", *stack).where("kind = 1")
    active = F.coalesce(*(F.when(F.col("key").startswith(F.col(f"open{d}")["path"]), F.col(f"open{d}")) for d in range(levels, -1, -1)))
    hits = swept.select("host", F.col("key").alias("path"), active.alias("rule")).where("rule is not null")
    longest = F.max(F.struct(F.length("rule.host").alias("h"), F.length("rule.path").alias("p"), F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.action").alias("action")))
    verdicts = hits.groupBy("host", "path").agg(longest.alias("won"))
    return urls.join(verdicts, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


def _nested(known: DataFrame) -> DataFrame:
    """The rules with their depth: how many rules of the same host have a shorter path that theirs starts with."""
    starts = known.select("under", "path", "host", "action", F.explode(F.expr("transform(sequence(0, length(path)), k -> substr(path, 1, k))")).alias("start"))
    outer = known.select("under", F.col("path").alias("start"))
    return starts.join(outer, ["under", "start"]).groupBy("under", "path", "host", "action").agg((F.count(F.lit(1)) - 1).cast("int").alias("depth"))
