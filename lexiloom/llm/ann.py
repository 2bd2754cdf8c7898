"""Approximate nearest neighbours by adaptive dimension scan.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2), which is zero for a
query.  An inverted file over these vectors (centroids from a bounded sample; every row is indexed) gives the
lists that a query probes.  Within a list, vectors lie in column blocks of a random rotation: after each block
of dimensions the partial distance, scaled to all dimensions, estimates the distance, and a candidate is
abandoned as soon as a hypothesis test rejects that it is nearer than the query's current k-th neighbour.
Survivors are measured exactly, on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, materialize
from .vectors import k_means, matrix, random_rotation, valid_vectors

#: Dimensions of a column block.
BLOCK = 16


def scan(qs, rotated, limits, x, columns, epsilon: float):
    """(query, row) pairs that the tests leave, and their products on the original vectors.

    ``rotated`` and ``columns`` (dimensions x rows) are rotated; ``limits``: for each query a squared distance
    that k others are known to reach.  The test at d of D dimensions rejects a candidate at
    partial * D / d > limit * (1 + epsilon / sqrt(d))^2.  While most pairs are alive, a block is added for all
    of them by matrix products; then only for those alive.
    """
    dim, partial, pairs = rotated.shape[1], 0.0, None
    for a in range(0, dim, BLOCK):
        z = min(a + BLOCK, dim)
        allow = limits * ((1 + epsilon / z**0.5) ** 2 if z < dim else 1 + 1e-9) + 1e-9
        if pairs is None:
            q, c = rotated[:, a:z], columns[a:z]
            partial = partial + (q * q).sum(1)[:, None] + (c * c).sum(0)[None] - 2 * q @ c
            alive = partial * (dim / z) <= allow[:, None]
            if z == dim or alive.mean() < 0.2:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            d = columns[a:z, pairs[1]] - rotated[pairs[0], a:z].T
            partial = partial + np.einsum("ij,ij->j", d, d)
            keep = partial * (dim / z) <= allow[pairs[0]]
            pairs, partial = (pairs[0][keep], pairs[1][keep]), partial[keep]
    score = np.concatenate([(qs[pairs[0][i : i + 65536]] * x[pairs[1][i : i + 65536]]).sum(1) for i in range(0, len(pairs[0]), 65536)] or [np.zeros(0)])
    return *pairs, score


def search(
    vectors: DataFrame, is_query, k: int = 20, lists: int | None = None, probe: float = 0.7, epsilon: float = 2.1,
    sample: int = 8192, block_rows: int = 8192, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, by inner product, ties to smaller ids.

    ``vectors``: vec_id, embedding; ``is_query``: condition on vec_id that picks the queries among the rows.
    Rows whose vector is null, empty, zero or holds null or non-finite components, or whose id is null, neither
    ask nor answer.  A query is no candidate of its own id.  Of rows that share an id the
    one with the largest product stands for it; as queries they count as one.  Fewer than ``k`` candidates: all of them.  All vectors must have one dimension.

    The index is fitted on the ``sample`` rows of smallest hashed id; ``lists`` defaults to 1.4 times
    the square root of their number.  A query probes its nearest lists until they hold the share ``probe`` of all rows,
    and more than ``k`` rows: for vectors without clusters the nearest ones lie everywhere, and 0.9 of recall
    needs a large share.  Lists are split into blocks of about ``block_rows`` rows, so none meets in one task.
    """
    spark = vectors.sparkSession
    rows = materialize(valid_vectors(vectors), "ann-rows")
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not head:
        return spark.createDataFrame([], schema)
    head = list({r.vec_id: r for r in head}.values())
    fit = np.stack([np.frombuffer(r.v, "<f8") for r in head])
    dim = fit.shape[1]
    norm = map_rows(rows, lambda bs: ([[float((matrix(b.column("v"), dim) ** 2).sum(1).max(initial=0.0))]] for b in bs), "m double")
    top = norm.agg(F.max("m")).first()[0]

    def lifted(x):
        return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]])

    lists = min(len(fit), lists or max(1, round(1.4 * len(fit) ** 0.5)))
    centroids = k_means(lifted(fit), lists, seed)
    rotation = random_rotation(dim + 1, seed)
    seeds = lifted(fit)
    seed_list = np.argmin((centroids * centroids).sum(1)[None] - 2 * seeds @ centroids.T, axis=1)
    seed_ids = np.array([r.vec_id for r in head])
    shared = spark.sparkContext.broadcast((centroids, rotation, seeds, seed_ids, seed_list))

    def assign(batches: Iterator[pa.RecordBatch]):
        c = shared.value[0]
        for b in batches:
            x = lifted(matrix(b.column("v"), dim))
            yield [b.column("vec_id"), b.column("v"), np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)]

    indexed = materialize(map_rows(rows, assign, "vec_id long, v binary, list int"), "ann-index")
    sizes = np.zeros(lists, np.int64)
    for i, n in indexed.groupBy("list").count().collect():  # one row per list, at most 1.4 sqrt(sample)
        sizes[i] = n
    blocks = np.maximum(1, -(-sizes // block_rows))
    need = max(probe * sizes.sum(), k + 1)

    def probes(batches: Iterator[pa.RecordBatch]):
        c, _, seeds, seed_ids, seed_list = shared.value
        for b in batches:
            x = matrix(b.column("v"), dim)
            far = (c * c).sum(1)[None] - 2 * x @ c[:, :-1].T
            order = np.argsort(far, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            n = np.minimum((held < need).sum(1) + 1, lists)
            # the k-th nearest of the sample within the probed lists (other than the query) is known from the start
            d = np.maximum(0, (x * x).sum(1)[:, None] + (seeds * seeds).sum(1)[None] - 2 * x @ seeds[:, :-1].T)
            place = np.argsort(order, axis=1)
            ids = b.column("vec_id").to_numpy()
            d[(place[:, seed_list] >= n[:, None]) | (seed_ids[None] == ids[:, None])] = np.inf
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(seeds) >= k else np.full(len(x), np.inf)
            q = np.repeat(np.arange(len(x)), n)
            lst = np.concatenate([o[:m] for o, m in zip(order, n)]) if len(x) else np.zeros(0, int)
            q, lst = np.repeat(q, blocks[lst]), np.repeat(lst, blocks[lst])
            block = np.arange(len(lst)) - np.maximum.accumulate(np.where(
                np.r_[True, (lst[1:] != lst[:-1]) | (q[1:] != q[:-1])], np.arange(len(lst)), 0)) if len(lst) else lst
            ids, v = b.column("vec_id"), b.column("v")
            for s in range(0, len(q), 4096):
                at = pa.array(q[s : s + 4096])
                yield [ids.take(at), v.take(at), limit[q[s : s + 4096]], lst[s : s + 4096], block[s : s + 4096]]

    queries = map_rows(indexed.filter(is_query), probes, "query_id long, q binary, lim double, list int, block int")

    def known(batches: Iterator[pa.RecordBatch]):
        """The k nearest of the sample, which stand in where fewer than k are left by the tests."""
        _, _, seeds, seed_ids, _ = shared.value
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            score = matrix(b.column("v"), dim) @ seeds[:, :-1].T
            score[seed_ids[None] == ids[:, None]] = -np.inf
            n = min(k, len(seeds))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            row, col = np.nonzero(np.take_along_axis(score, at, 1) > -np.inf)
            at, x = at[row, col], matrix(b.column("v"), dim)
            yield [ids[row], seed_ids[at], (x[row] * seeds[at, :-1]).sum(1)]

    seeded = map_rows(indexed.filter(is_query), known, "query_id long, vec_id long, score double")
    counts = spark.sparkContext.broadcast(blocks)

    def blocked(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            lst = b.column("list").to_numpy()
            # blocks by a hash of the id spread the copies of one vector
            yield [b.column("vec_id"), b.column("v"), b.column("list"), ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % counts.value[lst]]

    candidates = map_rows(indexed, blocked, "vec_id long, v binary, list int, block int")

    def best(key, asked: pa.Table, found: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and found.num_rows:
            x = matrix(found.column("v").combine_chunks(), dim)
            ids = found.column("vec_id").to_numpy()
            columns = np.ascontiguousarray((lifted(x) @ shared.value[1]).T)
            qs = matrix(asked.column("q").combine_chunks(), dim)
            rotated = np.hstack([qs, np.zeros((len(qs), 1))]) @ shared.value[1]
            q_ids, limits = asked.column("query_id").to_numpy(), asked.column("lim").to_numpy()
            step = max(1, 2_000_000 // len(x))
            for s in range(0, len(qs), step):
                q, at, score = scan(qs[s : s + step], rotated[s : s + step], limits[s : s + step], x, columns, epsilon)
                q, at, score = (v[q_ids[s + q] != ids[at]] for v in (q, at, score))
                order = np.lexsort((ids[at], -score, q))
                q, at, score = q[order], at[order], score[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                for o, v in zip(out, (q_ids[s + q], ids[at], score)):
                    o.append(v[rank < k])
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), out)})

    pairs = queries.groupBy("list", "block").cogroup(candidates.groupBy("list", "block")).applyInArrow(
        best, "query_id long, vec_id long, score double"
    )
    # the sample's own neighbours only fill up queries for which the tests abandoned too many
    pairs = pairs.withColumn("filler", F.lit(0)).unionByName(seeded.withColumn("filler", F.lit(1)))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("filler").alias("filler"))
    scanned = F.row_number().over(Window.partitionBy("query_id").orderBy("filler", F.desc("score"), "vec_id"))
    pairs = pairs.withColumn("scanned", scanned).filter(F.col("scanned") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
