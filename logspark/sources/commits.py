"""Small commit records in a folder, on whatever file system the folder lives on.

A record is written aside and renamed into place, so a reader sees it whole or not at all, and of two writers of one
name only the first succeeds.
"""

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """The file operations that commits need, by the file system of the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in the folder or a folder below it, sorted; none where there is no such folder."""
        if not self._fs.exists(self._path(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = False) -> bool:
        """Create a file whole. False if there is one already and it is not to be replaced."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(aside), True)
        stream.write(text.encode())
        stream.close()
        return self.move(aside, name, replace)

    def move(self, name: str, to: str, replace: bool = False) -> bool:
        """Rename a file or folder. False, and it is gone, if the new name is taken and not to be replaced."""
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(name), self._path(to), how)
            return True
        except Exception:
            if not self.exists(to):
                raise
            self.delete(name)
            return False


class CommitLog:
    """Named JSON records below a folder, in the order of their names."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.folder.names() if n.endswith(".json")]

    def has(self, name: str) -> bool:
        return self.folder.exists(f"{name}.json")

    def read(self, name: str) -> dict:
        return json.loads(self.folder.read(f"{name}.json"))

    def add(self, name: str, record: dict, replace: bool = False) -> bool:
        return self.folder.write(f"{name}.json", json.dumps(record), replace)

    def drop(self, name: str) -> None:
        self.folder.delete(f"{name}.json")
