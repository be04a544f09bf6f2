"""A table in numbered folders: a version counts once its write is committed, and the last one is read. So a reader never meets a half-written table, nor none."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        p = self._hadoop.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, mark: str = "_SUCCESS") -> list[int]:
        """The committed versions. ``mark``: the file that the last write of a version leaves."""
        p, fs = self._at(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if re.fullmatch("v[0-9]+", n) and fs.exists(self._hadoop.Path(f"{self.path}/{n}/{mark}")))

    def current(self, mark: str = "_SUCCESS") -> str | None:
        done = self.numbers(mark)
        return f"{self.path}/v{done[-1]}" if done else None

    def next(self, mark: str = "_SUCCESS") -> str:
        """The folder of a version to come; what an interrupted write has left there goes."""
        done = self.numbers(mark)
        path = f"{self.path}/v{done[-1] + 1 if done else 1}"
        p, fs = self._at(path)
        fs.delete(p, True)
        return path

    def prune(self, mark: str = "_SUCCESS") -> None:
        """Delete all but the last two versions: frames made before the last write can still be read."""
        for n in self.numbers(mark)[:-2]:
            p, fs = self._at(f"{self.path}/v{n}")
            fs.delete(p, True)
