"""Versions of tables in a folder, each committed once.

A version is a folder with one Parquet table per name.  It counts once its commit record exists: an empty file
whose name holds the version, the stream's id and the micro-batch's number, made in one step after all tables are
written.  A batch that has a record is skipped, so running it again changes nothing; what a lost attempt left behind
has no record and is overwritten by the next one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_RECORD = re.compile(r"(\d+)-(.+)-(\d+)")


class Snapshots:
    """Tables under ``folder`` (shared by all executors).  The last ``keep`` versions stay readable."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def records(self) -> list[tuple[int, str, int]]:
        """(version, stream, batch) of every commit, in order of version."""
        fs, path = self._fs(), self._path("commits")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        found = [m.groups() for m in map(_RECORD.fullmatch, names) if m]
        return sorted((int(v), stream, int(batch)) for v, stream, batch in found)

    def read(self) -> dict[str, DataFrame]:
        """Tables of the last committed version."""
        done = self.records()
        if not done:
            raise LookupError(f"no committed version under {self.folder}")
        return self._tables(done[-1][0])

    def _tables(self, version: int) -> dict[str, DataFrame]:
        names = [f.getPath().getName() for f in self._fs().listStatus(self._path(f"v={version}"))]
        return {n: self.spark.read.parquet(f"{self.folder}/v={version}/{n}") for n in sorted(names)}

    def start(self, tables: dict[str, DataFrame]) -> None:
        """Write the first version, unless there is one."""
        if not self.records():
            self._write(0, tables)
            self._commit(0, "start", 0)

    def apply(self, stream: str, batch: int, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
        """Next version by ``change`` of the last one's tables; nothing, and False, where the batch is committed."""
        done = self.records()
        if any(r[1:] == (stream, batch) for r in done):
            return False
        version = done[-1][0] + 1
        self._write(version, change(self._tables(done[-1][0])))
        self._commit(version, stream, batch)
        fs = self._fs()
        if fs.exists(self._path(f"v={version - self.keep}")):
            fs.delete(self._path(f"v={version - self.keep}"), True)
        return True

    def _write(self, version: int, tables: dict[str, DataFrame]) -> None:
        self._fs().delete(self._path(f"v={version}"), True)
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/v={version}/{name}")

    def _commit(self, version: int, stream: str, batch: int) -> None:
        self._fs().mkdirs(self._path("commits"))
        if not self._fs().createNewFile(self._path("commits", f"{version}-{stream}-{batch}")):
            raise RuntimeError(f"version {version} was committed by another writer")
