"""Numbered commits in a folder of the shared store: small texts that exist as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Commits:
    """Commits of one folder. A number is given once: the file of a commit is written aside and moved to its name, which fails if
    there is one. Needs one writer at a time, as a stream has; readers may come at any time."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self._conf), where

    def numbers(self) -> list[int]:
        """All numbers, ascending."""
        fs, where = self._at("")
        if not fs.exists(where):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """The last number; 0 where there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> str:
        fs, where = self._at(f"{number:012d}")
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def commit(self, number: int, text: str = "") -> None:
        fs, aside = self._at(f".{number:012d}.writing")
        stream = fs.create(aside, True)
        stream.write(text.encode())
        stream.close()
        _, to = self._at(f"{number:012d}")
        if fs.exists(to) or not fs.rename(aside, to):
            raise FileExistsError(f"{self.path}: commit {number} exists")
