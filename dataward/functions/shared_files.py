"""The folder that driver and executors share, small files in it, and a log of commits."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    It is an error to have none on a cluster, where no other folder is seen by all. A local session without
    one, as in tests, gets a new temporary folder and keeps it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="dataward-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


class Files:
    """Small files and folders, through the file system that Spark uses for the path."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Sorted names of the entries of a folder; none where there is no such folder."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        """Remove a file or folder; nothing happens where there is none."""
        fs, p = self._at(path)
        fs.delete(p, True)

    def create(self, path: str, text: str) -> bool:
        """Put a whole file in place at once; False if there is one already."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        draft = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return fs.rename(draft, p)


class CommitLog:
    """Numbered commits, each a JSON file that appears whole or not at all.

    A table's files take effect only through the commit that names them, so whatever a failed writer leaves
    behind is never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), folder

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith(".")]

    def get(self, number: int) -> dict | None:
        path = f"{self.folder}/{number:012d}.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else None

    def latest(self, before: int | None = None) -> tuple[int, dict] | None:
        """The newest commit, or the newest below a number."""
        done = [n for n in self.numbers() if before is None or n < before]
        return (max(done), self.get(max(done))) if done else None

    def append(self, number: int, commit: dict) -> bool:
        """False if the number is taken: another writer was faster."""
        return self.files.create(f"{self.folder}/{number:012d}.json", json.dumps(commit, sort_keys=True))
