"""Vectors as binary columns, in which null, zero and non-finite ones are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (little-endian doubles) of rows whose vector is not null, empty or zero and has only finite parts."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, out = [], []
            for i, e in zip(b.column("vec_id").to_pylist(), b.column("e")):
                values = e.values
                if values is None or len(values) == 0 or values.null_count:
                    continue
                x = values.to_numpy()
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.astype("<f8").tobytes())
            yield [ids, out]

    return map_rows(rows.filter("vec_id is not null and e is not null"), pack, "vec_id long, v binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    data = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def random_rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centroids of a bounded sample; empty ones keep their place."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(x[order], first, axis=0) / np.diff([*first, len(x)])[:, None]
    return c
