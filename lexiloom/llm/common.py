"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.ordered import dedupe_first
from ..session import shared_folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and keeps later passes from computing ``df`` again.  The folder is removed when
    the driver's JVM ends, so every DataFrame built on the result stays readable until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def once_per_worker(key: tuple, build: Callable):
    """``build()``, kept in the worker's process for later tasks.

    This package's functions travel by value, so their module's own globals do not last from task to task.
    """
    kept = sys.modules.setdefault("_lexiloom_worker", types.ModuleType("_lexiloom_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def arrow_schema(schema: StructType | str) -> pa.Schema:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return to_arrow_schema(schema)


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: fewer of them at a time bound what a worker and its executor hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def map_rows(
    df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], schema: str
) -> DataFrame:
    """``mapInArrow`` for a generator of column lists in the order of ``schema``."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each doc_id: the one of smallest hash of its text, then smallest text, then the first by its other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.xxhash64("text"), F.col("text"), *([F.to_json(F.struct(*others))] if others else [])]
    return dedupe_first(docs, ["doc_id"], order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text under fixed names, so that other columns cannot clash; null text is empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
