"""Small files on the shared storage, through the file system of their path."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFolder:
    """A folder on any storage Spark can reach; names are relative to it. For the driver only."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        # The class itself: looking it up by its package name costs the driver a search through all jars.
        self._path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path_of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path_of(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        if not self._system.exists(at):
            return []
        return sorted(found.getPath().getName() for found in self._system.listStatus(at))

    def exists(self, name: str) -> bool:
        return self._system.exists(self._at(name))

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files in a folder."""
        return self._system.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Create a file with its whole text at once; false if the name is taken."""
        if self.exists(name):
            return False
        draft = self._at(f".draft-{uuid.uuid4().hex}")
        stream = self._system.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._at(name)
        self._system.mkdirs(target.getParent())
        return bool(self._system.rename(draft, target))

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)
