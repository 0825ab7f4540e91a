"""An append-only log that several sessions may write at once.

An entry is a small file below a folder for its day, renamed into place, so that readers see it whole or not at all and no writer
waits for another. Packing moves entries to one Parquet table: the table is written first, then `packed.json` names it and
the files it replaces, and only then do these go; a packing that dies between leaves nothing lost or counted twice.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarrylight.sources.hadoop import Files

#: Seconds after which another session may take over a packing.
STALE = 600.0


class Log:
    """Entries of one schema, which has a string column id, below a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.schema, self.files = spark, schema, Files(spark, folder)

    def append(self, **entry) -> str:
        """Adds an entry and gives its id; times as datetime or ISO text."""
        entry = {"id": uuid.uuid4().hex} | entry
        day = f"day={datetime.now(timezone.utc):%Y-%m-%d}"
        self.files.make(self.files.at("entries", day))
        # Without the dot the file can be read: Spark leaves out names that begin with one.
        hidden, name = self.files.at("entries", day, f".{entry['id']}"), self.files.at("entries", day, f"{entry['id']}.json")
        self.files.create(hidden, json.dumps(entry, default=lambda x: x.isoformat() if isinstance(x, datetime) else str(x)))
        self.files.move(hidden, name)
        return entry["id"]

    def _packed(self) -> dict:
        try:
            return json.loads(self.files.read(self.files.at("packed.json")))
        except FileNotFoundError:
            return {"table": None, "merged": []}

    def _paths(self, merged: set[str]) -> list[str]:
        days = self.files.names(self.files.at("entries"))
        return [self.files.at("entries", d, n) for d in days for n in self.files.names(self.files.at("entries", d)) if n.endswith(".json") and n not in merged]

    def read(self) -> DataFrame:
        """All entries."""
        packed = self._packed()
        out = self.spark.createDataFrame([], self.schema)
        if packed["table"]:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(self.files.at(packed["table"])))
        if paths := self._paths(set(packed["merged"])):
            out = out.unionByName(self.spark.read.schema(self.schema).json(paths))
        return out

    def pack(self) -> int:
        """Moves the entries to the packed table; how many files it took. 0 if another session is packing."""
        lock = self.files.at("packing")
        if not self.files.create(lock, ""):
            probe = self.files.at(f".clock-{uuid.uuid4().hex}")
            self.files.create(probe, "")
            stale = self.files.changed(probe) - self.files.changed(lock) > STALE
            self.files.delete(probe)
            if not stale:
                return 0
            self.files.delete(lock)
            return self.pack()
        try:
            before = self._packed()
            for path in self._paths(set()):  # what a packing that died left behind
                if path.rsplit("/", 1)[1] in before["merged"]:
                    self.files.delete(path)
            paths = self._paths(set(before["merged"]))
            if not paths:
                return 0
            table, names = f"table-{uuid.uuid4().hex}", [p.rsplit("/", 1)[1] for p in paths]
            found = self.spark.read.schema(self.schema).json(paths)
            if before["table"]:
                found = found.unionByName(self.spark.read.schema(self.schema).parquet(self.files.at(before["table"])))
            found.write.parquet(self.files.at(table))
            self.files.replace(self.files.at("packed.json"), json.dumps({"table": table, "merged": names}))
            for p in paths:
                self.files.delete(p)
            if before["table"]:
                self.files.delete(self.files.at(before["table"]))
            return len(paths)
        finally:
            self.files.delete(lock)
