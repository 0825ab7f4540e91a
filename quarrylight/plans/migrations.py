"""Older generations, brought to the present schema while they are read.

A step takes a reader of one version's tables and gives a reader of the next version's; steps are chained, and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import schemas

Reader = Callable[[str], DataFrame]


class NoMigration(LookupError):
    """No chain of steps leads from a version to the present one."""


def _counted_status(read: Reader) -> Reader:
    """1 to 2: the status row has the counts, here taken from the tables themselves."""

    def table(name: str) -> DataFrame:
        if name != "index_status":
            return read(name)
        by = lambda c, v: F.count_if(F.col(c) == v)
        n = F.count(F.lit(1))
        counts = [
            read("files").agg(n.alias("files"), by("parse_status", "parsed").alias("parsed"), by("parse_status", "not_applicable").alias("not_applicable"), by("parse_status", "error").alias("errors")),
            read("symbols").agg(n.alias("symbols"), by("symbol_type", "route").alias("routes")),
            read("nodes").agg(n.alias("nodes"), by("node_type", "import").alias("imports"), by("node_type", "test").alias("tests")),
            read("edges").agg(n.alias("edges")),
            read("chunks").agg(n.alias("chunks")),
            read("embeddings").agg(n.alias("vectors")),
            read("diagnostics").agg(by("severity", "warning").alias("warnings"), by("severity", "error").alias("fatal_errors")),
        ]
        out = read(name)
        for one in counts:  # one row each
            out = out.drop(*one.columns).crossJoin(F.broadcast(one))
        return out

    return table


#: By the version that a step starts from.
STEPS: dict[int, Callable[[Reader], Reader]] = {1: _counted_status}


def migrated(spark: SparkSession, table: str, read: Reader, version: int) -> DataFrame:
    """A table of an older version in the present schema; columns that no step fills are null."""
    if not 0 < version <= schemas.SCHEMA_VERSION:
        raise NoMigration(f"version {version}")
    for v in range(version, schemas.SCHEMA_VERSION):
        if v not in STEPS:
            raise NoMigration(f"no step from version {v}")
        read = STEPS[v](read)
    found = read(table)
    return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[table]))
