"""A report folder as a Spark data source: every task writes a file of its own, and one manifest names those that count.

Task files get their names once, so a task that runs again leaves its first file behind unnamed.  The driver writes
the manifest last and in one step; until then, and after an abort, readers see the report that was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"


def open_folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def named_files(path: str) -> list[dict]:
    """Files the manifest names, none without one."""
    files, root = open_folder(path)
    try:
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())["files"]
    except FileNotFoundError:
        return []


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """A line for each row of the task."""
        files, root = open_folder(self.path)
        name, rows, size = f"part-{uuid.uuid4().hex}.json", 0, 0
        files.create_dir(root)
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                lines = "".join(line + "\n" for line in batch.column(0).to_pylist() if line is not None).encode()
                out.write(lines)
                rows, size = rows + batch.num_rows - batch.column(0).null_count, size + len(lines)
        return _Written(name, rows, size)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = open_folder(self.path)
        before = named_files(self.path)
        made = [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in messages if m is not None]
        kept = made if self.overwrite else before + made
        draft = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"rows": sum(f["rows"] for f in kept), "files": kept}).encode())
        files.move(draft, f"{root}/{MANIFEST}")
        for f in before if self.overwrite else []:
            self._delete(files, f"{root}/{f['name']}")

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = open_folder(self.path)
        for m in messages:
            if m is not None:
                self._delete(files, f"{root}/{m.name}")

    @staticmethod
    def _delete(files, path: str) -> None:
        try:
            files.delete_file(path)
        except FileNotFoundError:
            pass


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(f["name"]) for f in named_files(self.path)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a report without files
            return
        files, root = open_folder(self.path)
        with files.open_input_stream(f"{root}/{partition.name}") as f:
            rest = b""
            while data := f.read(1 << 20):
                *lines, rest = (rest + data).split(b"\n")
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])


class ReportSource(DataSource):
    """Format ``json_report``: one column of lines, option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "json_report"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def publish_report(df: DataFrame, path: str, append: bool = False) -> None:
    """Write rows as JSON lines, the new report replacing the old one at once (or added to it)."""
    df.sparkSession.dataSource.register(ReportSource)
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format("json_report").option("path", path).mode("append" if append else "overwrite").save()


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a published report."""
    spark.dataSource.register(ReportSource)
    lines = spark.read.format("json_report").option("path", path).load()
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
