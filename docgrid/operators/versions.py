"""Versions of a set of tables: readers see one version whole, a writer replaces the version that it has read or nothing.

A version is a list of the tables' folders. A commit writes the tables that it
changes into new folders, then creates the list of the next number, which only
one of several writers can: the others have lost and start again from what is
there now. Folders are never written twice, so a reader's version stays as it
is, and a writer that dies leaves nothing that anyone reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """The version that a change was made for isn't the newest."""


class Versions:
    def __init__(self, spark: SparkSession, where: str) -> None:
        """``where``: a folder that driver and executors share."""
        self.spark, self.where = spark, where.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, version: int):
        return self._hadoop.Path(f"{self.where}/_versions/{version:012d}.json")

    def head(self) -> int:
        """The newest version, 0 before the first."""
        folder = self._hadoop.Path(f"{self.where}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._list(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the newest if none is named."""
        folders = self._folders(self.head() if version is None else version)
        return {name: self.spark.read.parquet(f"{self.where}/{folder}") for name, folder in folders.items()}

    def commit(self, expected: int, changes: Mapping[str, DataFrame]) -> int:
        """Put the tables of ``changes`` in place of those of version ``expected``; gives the new version's number.

        Raises ``Conflict``, and leaves the newest version as it is, if that
        isn't ``expected`` or another writer is first.
        """
        if self.head() != expected:
            raise Conflict(f"version {self.head()} is newer than {expected}")
        folders, new = self._folders(expected), {}
        for name, df in changes.items():
            new[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.where}/{new[name]}")
        try:
            stream = self._fs.create(self._list(expected + 1), False)  # fails if it exists
        except Exception as e:
            for folder in new.values():
                self._fs.delete(self._hadoop.Path(f"{self.where}/{folder}"), True)
            raise Conflict(f"version {expected + 1} was written by another") from e
        try:
            stream.write(bytearray(json.dumps({**folders, **new}).encode()))
        finally:
            stream.close()
        return expected + 1
