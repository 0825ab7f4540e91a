"""The scan of a source tree: paths are listed, contents read and judged on executors.

Spark's own file sources leave out names that start with _ or a dot, so files are listed by a data source of our own (sources.tree;
ignored directories are never entered) and read in mapInPandas tasks; everything after reading is column expressions.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import running, secrets, text
from quarrylight.sources import tree

# What is never indexed, and the limits of a repository.
IGNORED_DIRS = (".git", ".quarrylight", "node_modules", "__pycache__", ".venv", "venv")
IGNORED_NAMES = (".env", ".env.*", "*.pyc", "*.pyo")
MAX_FILES, MAX_BYTES, MAX_FILE_BYTES = 10_000, 52_428_800, 1_048_576
IGNORE_FILES = (".gitignore", ".quarryignore")


@dataclass(frozen=True)
class IgnoreRules:
    """Patterns from the ignore files at the root, as one regular expression over relative paths."""

    regex: str

    @staticmethod
    def of(patterns: list[str]) -> IgnoreRules:
        body = text.glob_body
        parts = [rf"(?:^|/)(?:{'|'.join(map(body, IGNORED_DIRS))})(?:/|\z)"]
        parts += [rf"(?:^|/){body(p).replace(body('*'), '[^/]*')}\z" for p in IGNORED_NAMES]
        for p in patterns:
            if p.startswith("/"):
                parts.append(text.glob_regex(p.lstrip("/")))
            elif p.endswith("/"):
                name = body("".join(f"[{c}]" if c in "*?[" else c for c in p.rstrip("/")))
                parts += [rf"(?:^|/){name}(?:/|\z)", text.glob_regex(p)]
            elif "/" in p:
                parts.append(text.glob_regex(p))
            else:
                parts += [text.glob_regex(p), text.glob_regex(f"**/{p}")]
        return IgnoreRules("|".join(f"(?:{p})" for p in parts))

    @staticmethod
    def load(root: str, names: tuple[str, ...] = IGNORE_FILES) -> IgnoreRules:
        patterns = []
        for name in names:
            path = os.path.join(root, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    patterns += [x.strip() for x in f if x.strip() and not x.strip().startswith("#")]
        return IgnoreRules.of(patterns)

    def matches(self, path: str) -> bool:
        return re.search(self.regex.replace(r"\z", r"\Z"), path) is not None

    def column(self, path: Column) -> Column:
        return path.rlike(self.regex)


def is_env_file(path: Column) -> Column:
    return text.basename(path).rlike(r"(?s)^\.env(\..*)?\z")


def listed(spark: SparkSession, root: str, rules: IgnoreRules) -> DataFrame:
    """path, absolute_path, is_link and ignored of every file outside ignored directories; seq rises in the order of the walk.

    The walk's order has files of a folder before its folders. `root` is a local path or any URI that tree.py can list.
    """
    spark.dataSource.register(tree.TreeSource)
    parts = spark.sparkContext.defaultParallelism
    found = spark.read.format(tree.NAME).option("parts", str(parts)).option("pattern", rules.regex.replace(r"\z", r"\Z")).load(root)
    rows = found.orderBy("place").select(F.monotonically_increasing_id().alias("seq"), "path", "absolute_path", "is_link")
    return rows.withColumn("ignored", rules.column(F.col("path")))


def _reader(root: str):
    def read(frames):
        for frame in frames:
            contents, sizes = [], []
            for path, wanted in zip(frame["absolute_path"], frame["wanted"], strict=True):
                data, size = _content(root, path) if wanted else (None, None)
                contents.append(data)
                sizes.append(size)
            yield frame.assign(content=contents, size_bytes=pd.array(sizes, dtype="Int64")).drop(columns=["wanted"])

    return read


def _content(root: str, path: str) -> tuple[bytes | None, int | None]:
    """The first bytes of a file, one more than the limit, and its size; None for what can't be read."""
    size = None
    try:
        if urlparse(root).scheme in ("", "file"):
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                return f.read(MAX_FILE_BYTES + 1), size
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        size = system.get_file_info(path).size
        with system.open_input_stream(path) as f:
            return f.read(MAX_FILE_BYTES + 1), size
    except OSError:
        return None, size


def read_contents(files: DataFrame, root: str = "") -> DataFrame:
    """The listed files with size_bytes and content (null if unreadable, at most one byte over the limit); root tells the file system."""
    n = max(1, min(files.sparkSession.sparkContext.defaultParallelism * 4, 200))
    wanted = files.withColumn("wanted", ~F.col("ignored") & ~F.col("is_link")).repartition(n)
    return wanted.mapInPandas(_reader(root), "seq long, path string, absolute_path string, is_link boolean, ignored boolean, content binary, size_bytes long")


def skip_reason(read: DataFrame) -> Column:
    """Why a file isn't indexed, in order of the checks; null if it is. Details after a colon."""
    size = F.col("size_bytes")
    return (
        F.when(F.col("ignored"), "ignored_by_rules: matched an ignore rule")
        .when(F.col("is_link"), "symlink_skipped: symbolic link")
        .when(size.isNull(), "file_skipped: could not stat or read file")
        .when(size == 0, "file_skipped: empty file")
        .when(text.name_extension(F.col("path")).isin(*text.BINARY_EXTENSIONS), "file_skipped: binary file")
        .when(F.col("content").isNull(), "file_skipped: could not read file")
        .when(size > MAX_FILE_BYTES, F.concat(F.lit("file_skipped: file too large ("), size.cast("string"), F.lit(f" bytes > {MAX_FILE_BYTES})")))
    )


def scan(spark: SparkSession, root: str, *, ignore_files: tuple[str, ...] = IGNORE_FILES, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics) of a source tree; files as schemas.SCANNED, diagnostics as schemas.DIAGNOSTICS."""
    root = os.path.abspath(root)
    read = read_contents(listed(spark, root, IgnoreRules.load(root, ignore_files)), root)
    return judge(read, max_files=max_files, max_bytes=max_bytes)


def over_limits(files: DataFrame, key: str, *, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files with n and bytes, counted up to theirs in order of a key, and whether a limit is passed there."""
    total = running.running_total(files, key, {"n": F.lit(1), "bytes": F.col("size_bytes")})
    return total.withColumn("over", (F.col("n") > max_files) | (F.col("bytes") > max_bytes))


def judge(read: DataFrame, *, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Scanned files and diagnostics of files with their contents (seq, path, absolute_path, is_link, ignored, content, size_bytes)."""
    read = read.withColumn("reason", skip_reason(read))
    good = read.where("reason is null")
    whole = F.is_valid_utf8(F.col("content").cast("string"))
    decoded = F.when(whole, F.col("content").cast("string")).otherwise("")
    good = good.withColumn("is_binary", ~whole).withColumn("raw", decoded)
    scanned = good.select(
        "path",
        "absolute_path",
        "size_bytes",
        F.sha2("content", 256).alias("content_hash"),
        "is_binary",
        secrets.redact(F.col("raw")).alias("text"),
        text.line_count(F.col("raw")).alias("line_count"),
        secrets.has_secret(F.col("raw")).alias("has_secrets"),
        F.when(F.col("is_binary"), "doc").otherwise(text.file_type(F.col("path"))).alias("file_type"),
        F.when(text.name_extension(F.col("path")) == ".py", "Python").alias("language"),
        F.when(text.name_extension(F.col("path")) == ".py", "pending").otherwise("not_applicable").alias("parse_status"),
        "seq",
    )
    over = over_limits(good.select("seq", "path", "size_bytes"), "seq", max_files=max_files, max_bytes=max_bytes).where("over")
    severity = F.when(F.col("reason").startswith("file_skipped"), "warning").otherwise("info")
    told = read.where("reason is not null").select(F.substring_index("reason", ": ", 1).alias("code"), severity.alias("severity"), F.col("path").alias("file_path"), F.substring(F.expr("substring(reason, locate(': ', reason) + 2)"), 1, 500).alias("message"))
    found = scanned.where("has_secrets").select(F.lit("file_secret_detected").alias("code"), F.lit("warning").alias("severity"), F.col("path").alias("file_path"), F.lit("Secret detected and redacted").alias("message"))
    limits = over.select(F.lit("repository_limit_exceeded").alias("code"), F.lit("error").alias("severity"), F.col("path").alias("file_path"), F.concat(F.lit("over the limit at file "), F.col("n").cast("string"), F.lit(" and byte "), F.col("bytes").cast("string")).alias("message"))
    return scanned.drop("seq"), told.unionByName(found).unionByName(limits)
