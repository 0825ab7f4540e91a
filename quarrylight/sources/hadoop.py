"""Small files and folders on any file system that Spark knows: lists, texts, renames.

Used on the driver, for what a store keeps beside its tables; tables and contents are read and written by executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system of one path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.system = path.getFileSystem(self.conf)
        if self.system.getUri().getScheme() == "file":  # without checksum files, as others write here too
            self.system = self.system.getRawFileSystem() if hasattr(self.system, "getRawFileSystem") else self.system
        whole = self.system.makeQualified(path).toString()
        #: The root with its scheme.
        self.root = whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole

    def at(self, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), *names])

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self.system.getFileStatus(self._path(path)).isDirectory()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self._path(path)))

    def changed(self, path: str) -> float:
        """When a file was last written, in seconds by the file system's clock."""
        return self.system.getFileStatus(self._path(path)).getModificationTime() / 1000

    def make(self, path: str) -> None:
        self.system.mkdirs(self._path(path))

    def read(self, path: str) -> str:
        """A small text; FileNotFoundError if there is none."""
        if not self.exists(path):
            raise FileNotFoundError(path)
        try:
            stream = self.system.open(self._path(path))
            try:
                return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Exception as e:  # Py4J wraps all of Java's
            raise OSError(f"{path} can't be read") from e

    def create(self, path: str, text: str) -> bool:
        """Writes a text only if nothing is there; False if something is. The file system lets one of several callers win."""
        try:
            stream = self.system.create(self._path(path), False)
        except Exception as e:  # Py4J wraps all of Java's
            if self.exists(path):
                return False
            raise OSError(f"{path} can't be written") from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Writes a text in one step over what is there: readers see the old or the new one."""
        new = f"{path}.{uuid.uuid4().hex}"
        self.create(new, text)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        chosen = self.gateway.new_array(options, 1)
        chosen[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf).rename(self._path(new), self._path(path), chosen)

    def move(self, source: str, target: str) -> bool:
        """Renames; False if the target is there."""
        return not self.exists(target) and self.system.rename(self._path(source), self._path(target))

    def delete(self, path: str) -> None:
        self.system.delete(self._path(path), True)
