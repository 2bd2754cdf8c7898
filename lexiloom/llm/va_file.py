"""Exact top-k search by a vector-approximation file.

Components become integers, floor(scale * x).  Each dimension is cut into cells at quantiles of a sample's values, the outermost
closed by the smallest and largest component of all rows, and a vector's approximation is its cell in each
dimension, one byte each.  The first phase scans the approximations: a cell's ends bound what a dimension can add to an
inner product, so a query has a lower and an upper bound for every vector, and a vector whose upper bound is below the
k-th largest lower bound cannot be among the k best.  The second phase reads the exact vectors of the remaining ones in order
of their bounds, the most promising first, in growing portions, until no unread one can reach the k-th best found.

Nothing about the result depends on the sample: it only places the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ordered import top_k
from .common import map_rows, materialize
from .embed_dedup import groups

#: Rows that the cells are placed by, vectors and queries of a block, and queries that are bounded at a time.
SAMPLE, BLOCK, ASKED, STEP = 4096, 16384, 1024, 64


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, v (little-endian doubles, all integers): floor(scale * x) of vectors without null or non-finite components."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, dims, out = [], [], []
            for i, e in zip(b.column("vec_id").to_pylist(), b.column("e")):
                values = e.values
                if values is None or len(values) == 0 or values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(values.to_numpy() * float(scale))
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    out.append((x + 0.0).astype("<f8").tobytes())
            yield [ids, dims, out]

    packed = map_rows(rows.filter("vec_id is not null and e is not null"), pack, "vec_id long, dim int, v binary")
    return packed.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select("vec_id", "s.dim", "s.v")


def ends_of(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each dimension."""

    def rows(batches: Iterator[pa.RecordBatch]):
        low = high = None
        for b in batches:
            if b.num_rows:
                x = floats(b.column("v"), dim)
                low, high = (x.min(0), x.max(0)) if low is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        if low is not None:
            yield [[low.tobytes()], [high.tobytes()]]

    low, high = [], []
    for r in map_rows(vectors.select("v"), rows, "low binary, high binary").toLocalIterator():  # two rows of numbers a task
        low = [np.min([*low, np.frombuffer(r.low, "<f8")], axis=0)]
        high = [np.max([*high, np.frombuffer(r.high, "<f8")], axis=0)]
    return low[0], high[0]


def floats(column: pa.Array, dim: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(-1, dim).astype(np.float64)


def cells_of(vectors: DataFrame, dim: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper end of every cell, (dim, cells) each; cells that quantiles leave empty repeat the last."""
    low, high = ends_of(vectors, dim)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    x = np.stack([np.frombuffer(v, "<f8") for v in sample.v])
    starts = np.empty((dim, cells))
    for d in range(dim):  # among the values themselves: a frequent one needs no more than its own cell
        values = np.unique(x[:, d])
        starts[d] = values[np.arange(cells) * len(values) // cells]
    starts[:, 0] = low
    starts = np.clip(starts, low[:, None], high[:, None])
    starts.sort(axis=1)
    return starts, np.column_stack([np.maximum(starts[:, :-1], starts[:, 1:] - 1), high])


def approximate(vectors: DataFrame, dim: int, starts: np.ndarray, kind: str) -> DataFrame:
    """vec_id, cells (a byte for each dimension), v (in the given number type)."""
    shared = vectors.sparkSession.sparkContext.broadcast(starts)

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                x = floats(b.column("v"), dim)
                at = np.empty(x.shape, np.uint8)
                for d, s in enumerate(shared.value):
                    at[:, d] = np.maximum(np.searchsorted(s, x[:, d], "right") - 1, 0)
                yield b.column("vec_id"), [r.tobytes() for r in at], [r.tobytes() for r in x.astype(kind)]

    return map_rows(vectors.select("vec_id", "v"), rows, "vec_id long, cells binary, v binary")


def bounds(queries: DataFrame, file: DataFrame, dim: int, k: int, ends: tuple[np.ndarray, np.ndarray], kind: str, slack: float) -> DataFrame:
    """query_id, vec_id, low, high of pairs that the k-th largest lower bound in their block leaves possible.

    Blocks of queries meet blocks of the file.  ``slack``: relative rounding of a bound, 0 where sums of doubles are exact.
    """
    many = lambda df, size: max(1, -(-df.count() // size))
    nq, na = many(queries, ASKED), many(file, BLOCK)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(deal(nq).alias("q"), upto(na).alias("a"), F.lit(0).alias("side"), "vec_id", F.col("v").alias("x"))
    given = file.select(upto(nq).alias("q"), deal(na).alias("a"), F.lit(1).alias("side"), "vec_id", F.col("cells").alias("x"))
    met = asked.unionByName(given.select(*asked.columns)).repartition("q", "a").sortWithinPartitions("q", "a", "side")
    shared = file.sparkSession.sparkContext.broadcast(ends)

    def rows(batches: Iterator[pa.RecordBatch]):
        start, end = shared.value
        for g in groups(batches, 2):
            side, ids = g.column("side").to_numpy(), g.column("vec_id").to_numpy()
            m = int((side == 0).sum())
            if m in (0, len(ids)):
                continue
            x = g.column("x").combine_chunks()
            q = floats(x.slice(0, m), dim, kind)
            at = np.frombuffer(b"".join(v.as_buffer() for v in x.slice(m)), np.uint8).reshape(-1, dim)
            low, high = (np.take_along_axis(e.T, at, 0) for e in (start, end))
            for i in range(0, m, STEP):
                up, down = np.maximum(q[i : i + STEP], 0), np.minimum(q[i : i + STEP], 0)
                most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
                if slack:
                    size = slack * (up - down) @ np.maximum(np.abs(low), np.abs(high)).T
                    most, least = np.nan_to_num(most + size, nan=np.inf), np.nan_to_num(least - size, nan=-np.inf)
                own = ids[i : min(i + STEP, m), None] == ids[None, m:]
                most[own] = least[own] = -np.inf
                worst = np.partition(least, -k, axis=1)[:, -k] if least.shape[1] >= k else np.full(len(least), -np.inf)
                row, col = np.nonzero((most >= worst[:, None]) & ~own)
                yield ids[i : i + STEP][row], ids[m:][col], least[row, col], most[row, col]

    return map_rows(met, rows, "query_id long, vec_id long, low double, high double")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact row-wise inner products of integers held as doubles, cut to 64 bits."""
    size = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if size < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a, b)]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, e)) for e in exact], np.int64)


def read_exact(pairs: DataFrame, file: DataFrame, dim: int, kind: str) -> DataFrame:
    """query_id, vec_id, score of pairs (query_id, vec_id)."""
    right = file.select("vec_id", "v")
    both = pairs.select("query_id", "vec_id").join(right, "vec_id").join(
        right.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                yield b.column("query_id"), b.column("vec_id"), inner_products(*(floats(b.column(c), dim, kind) for c in ("q", "v")))

    return map_rows(both.select("query_id", "vec_id", "q", "v"), rows, "query_id long, vec_id long, score long")


def search_one(vectors: DataFrame, dim: int, is_query: str, k: int, cells: int) -> DataFrame | None:
    """query_id, vec_id, score of the k best of each query among vectors (vec_id, v) of one dimension."""
    order = [F.desc("score"), F.col("vec_id")]
    start, end = cells_of(vectors, dim, cells)
    largest = max(np.abs(start).max(), np.abs(end).max())
    kind = next((t for t in ("<i2", "<i4") if largest <= np.iinfo(t).max), "<f8")
    file = materialize(approximate(vectors, dim, start, kind), "va-file")
    exact = largest * largest * dim < 2.0**53
    found = materialize(bounds(file.filter(is_query), file, dim, k, (start, end), kind, 0.0 if exact else 1e-12), "bounds")
    least = top_k(found, ["query_id"], [F.desc("low"), F.col("vec_id")], k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(float("-inf")).alias("worst"))
    left = materialize(found.join(least, "query_id").filter("high >= worst").select("query_id", "vec_id", "high"), "candidates")
    best, portion = None, 2 * k
    while left.first() is not None:
        now = top_k(left, ["query_id"], [F.desc("high"), F.col("vec_id")], portion)
        read = read_exact(now, file, dim, kind)
        best = materialize(top_k(read if best is None else best.unionByName(read), ["query_id"], order, k), "best")
        kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
        last = now.groupBy("query_id").agg(F.max(F.struct((-F.col("high")).alias("h"), "vec_id")).alias("last"))
        unread = F.struct((-F.col("high")).alias("h"), "vec_id") > F.col("last")
        rest = left.join(last, "query_id").join(kth, "query_id").filter(unread)
        # rounding to a double may lower the kth best a little, which only reads more
        possible = F.col("kth").isNull() | (F.col("high") >= F.col("kth") - F.abs("kth") * 1e-15)
        left = materialize(rest.filter(possible).select("query_id", "vec_id", "high"), "candidates")
        portion *= 4
    return best


def search(
    vectors: DataFrame, is_query: str, k: int = 20, scale: int = 64, cells: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest integer inner products of each query, ties to the smaller id.

    Components are floor(scale * x).  ``is_query``: condition on vec_id; all other rows are candidates.  Vectors that are
    null, empty or hold null or non-finite components (also after scaling), and rows without an id, take no part;
    zero vectors do.  Of rows that share an id the vector with fewest components and smallest bytes stands.
    Vectors of different lengths never meet.  A query with fewer than ``k`` candidates gets them all, one
    with none no row; scores beyond 64 bits are cut to them; other columns are ignored.
    """
    rows = materialize(whole_vectors(vectors, scale, id_col, vector_col), "whole")
    out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    for dim in [r.dim for r in rows.select("dim").distinct().orderBy("dim").toLocalIterator()]:
        best = search_one(rows.filter(F.col("dim") == dim), dim, is_query, k, cells)
        out = out if best is None else out.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL, for the queries divisible by 20 and 20 results.
SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
