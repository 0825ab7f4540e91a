"""A Python data source that lists a source tree on executors: spark.read.format("quarrylight_tree").load(root).

Options: `pattern`, a regular expression over relative paths (directories that match are never entered), `parts` and `depth`. Each
of `parts` partitions walks the directories above `depth` and owns what is there by hash of its name; a directory at that depth
belongs to one partition with all below it. The driver lists nothing, so that no list of files is ever in its memory.

Local paths are listed with the standard library, which tells links; others (hdfs, s3, gs) through pyarrow's file systems. Names
that begin with a dot or an underscore are kept, unlike in Spark's own file sources.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, absolute_path string, is_link boolean, place string"
NAME = "quarrylight_tree"


def _entries(root: str, folder: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(name, whole path, is it a folder, is it a link) of what a folder holds; nothing where it can't be read."""
    where = urlparse(root)
    if where.scheme in ("", "file"):
        try:
            with os.scandir(folder) as found:
                yield from [(e.name, e.path, e.is_dir(), e.is_symlink()) for e in found]
        except OSError:
            return
        return
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(root)
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        yield info.base_name, info.path, info.type == fs.FileType.Directory, False


def start_of(root: str) -> str:
    """The root as its file system names it."""
    where = urlparse(root)
    if where.scheme in ("", "file"):
        return os.path.abspath(unquote(where.path)) if where.scheme else os.path.abspath(root)
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[1]


def walk(root: str, part: int, parts: int, depth: int, pattern: str | None) -> Iterator[tuple[str, str, bool, str]]:
    """The files of one partition. Linked folders are not entered and not listed."""
    ignored = re.compile(pattern) if pattern else None
    mine = lambda path: zlib.crc32(path.encode("utf-8", "surrogateescape")) % parts == part
    # (relative folder, its whole path, level, where it is in the walk, does all of it belong to this partition)
    work = [("", start_of(root), 0, "", parts == 1)]
    while work:
        inside, folder, level, place, owned = work.pop()
        for name, whole, is_folder, is_link in _entries(root, folder):
            path = inside + name
            if is_folder:
                if not is_link and not (ignored and ignored.search(path)) and (owned or level + 1 < depth or mine(path)):
                    work.append((path + "/", whole, level + 1, f"{place}1{name}\0", owned or level + 1 >= depth))
            elif owned or mine(path):
                yield path, whole, is_link, f"{place}0{name}"


class Part(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern")
        self.parts, self.depth = int(options.get("parts", "8")), int(options.get("depth", "2"))

    def partitions(self) -> list[InputPartition]:
        return [Part(i) for i in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        readable = lambda x: x.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        for row in walk(self.root, partition.number, self.parts, self.depth, self.pattern):
            yield tuple(readable(x) if isinstance(x, str) else x for x in row)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)
