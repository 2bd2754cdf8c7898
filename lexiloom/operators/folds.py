"""Streaming helpers for ordered folds inside sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

_DDL = {
    pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean",
    pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>",
}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*buffer), schema.types)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        buffer.append(row)
        if len(buffer) == size:
            yield flush()
            buffer = []
    if buffer:
        yield flush()


def fold_sorted(
    df: DataFrame, keys: list[str], order: list[str | Column], fold: Callable[[Iterator[tuple]], Iterator[tuple]],
    schema: pa.Schema,
) -> DataFrame:
    """Run ``fold`` over rows that stream in by (keys, order), all rows of a key in one task.

    Rows pass one Arrow batch at a time, so memory does not depend on the size of a key.
    """
    ddl = ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(lambda batches: _batches(fold(_rows(batches)), schema), ddl)
