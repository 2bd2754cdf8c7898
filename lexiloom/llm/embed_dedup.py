"""Embedding near-duplicates by NN-descent.

Equal vectors are one node with a weight.  Each node keeps a list of its nearest nodes found so far, first from
random-hyperplane leaves, then from neighbours of neighbours: in a round every node brings the members of its
list, and of the lists it is in, together, and pairs that are nearer than the worst of a list enter it.  A node
whose whole list lies above the threshold is saturated: it may have more links than its list holds.  Its list
is enlarged to all that neighbours of neighbours can reach, the component it belongs to, which is compared in
blocks.  An audit measures recall on a fixed number of other nodes against all vectors, and another round of leaves and
longer lists follows where it is too low.  There are as many leaf tables as a lone pair needs, which has no other
neighbour to be found through.  Links are the edges of at least the threshold.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, materialize
from .components import components
from .vectors import matrix, valid_vectors

EDGES = "a long, b long, s double"
NO_IDS = np.zeros(0, np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal leading ``keys`` columns in sorted rows, cut after ``most`` rows."""
    rest: pa.Table | None = None
    for b in with_end(batches):
        if b is not None:
            now = pa.Table.from_batches([b])
            rest = now if rest is None else pa.concat_tables([rest, now])
        if rest is None or rest.num_rows == 0:
            continue
        rest = rest.combine_chunks()
        change = np.zeros(rest.num_rows, bool)
        change[0] = True
        for k in range(keys):
            c = rest.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], rest.num_rows)
        done = len(starts) if b is None else len(starts) - 1
        for s, e in zip(starts[:done], ends[:done]):
            for x in range(s, e, most or int(e - s)):
                yield rest.slice(x, min(e, x + (most or e)) - x)
        rest = rest.slice(starts[done]) if done < len(starts) else None


def with_end(batches):
    yield from batches
    yield None


def best_of(ids: np.ndarray, s: np.ndarray, k: int, floor: float):
    """Edges of the ``k`` largest entries of each row of a similarity matrix, none below ``floor``."""
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return NO_IDS, NO_IDS, np.zeros(0)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(s, at, 1)
    row, col = np.nonzero(value >= floor)
    return ids[row], ids[at[row, col]], value[row, col]


def tables_for(n: int, leaf: int, threshold: float, missed: float) -> tuple[int, int]:
    """Hyperplanes of a table whose leaves hold about ``leaf`` of ``n`` nodes, and the number of tables after which a
    pair at the threshold has shared no leaf with a chance of ``missed``; it grows with the number of hyperplanes."""
    bits = max(1, min(30, round(np.log2(max(2, n / leaf)))))
    together = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log(missed) / np.log1p(-min(together, 1 - 1e-9)))))


def leaves(nodes: DataFrame, n: int, dim: int, k: int, floor: float, threshold: float, missed: float, seed: int, leaf: int = 64, split: int = 8192) -> DataFrame:
    """Edges within leaves of nodes that fall on the same sides of random hyperplanes, in several tables.

    Leaves are compared in single precision; pairs about as near as the threshold are measured again from the nodes.
    A side that more than ``split`` nodes fall on is dealt out by a hash of the id.
    """
    bits, tables = tables_for(n, leaf, threshold, missed)
    planes = np.random.default_rng(seed).standard_normal((tables, bits + 1, dim))
    shared = nodes.sparkSession.sparkContext.broadcast(planes)

    def sides(x: np.ndarray):
        for t, p in enumerate(shared.value):
            y = x @ p.T
            yield t, (y[:, :-1] > 0) @ (1 << np.arange(bits)), y[:, -1]

    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                for t, side, _ in sides(matrix(b.column("v"), dim)):
                    found, times = np.unique(side, return_counts=True)
                    yield [np.full(len(found), t), found, times]

    def code(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), dim)
                v = [r.tobytes() for r in x.astype("<f4")]
                for t, side, y in sides(x):
                    yield [np.full(len(x), t), side, b.column("id"), y, v]

    hot = map_rows(nodes.select("v"), count, "t int, side long, n long").groupBy("t", "side").agg(F.sum("n").alias("n")).filter(
        F.col("n") > split).select("t", "side", F.ceil(F.col("n") / split).alias("parts"))
    hot = materialize(hot, "hot-sides")
    coded = map_rows(nodes.select("id", "v"), code, "t int, side long, id long, y double, v binary")
    # at most as many rows as nodes / split in each table
    dealt = coded.join(hot, ["t", "side"], "left").withColumn("part", F.expr("coalesce(pmod(xxhash64(id, t), parts), 0)"))
    ordered = dealt.select("t", "side", "part", "y", "id", "v").repartition("t", "side", "part").sortWithinPartitions(
        "t", "side", "part", "y")

    def pairs(batches: Iterator[pa.RecordBatch]):
        for g in groups(batches, 3, 2 * leaf):
            x = np.frombuffer(b"".join(v.as_buffer() for v in g.column("v").combine_chunks()), "<f4").reshape(-1, dim)
            a, b, s = best_of(g.column("id").to_numpy(), x @ x.T, k, floor)
            yield a, b, s.astype(float)

    found = materialize(map_rows(ordered, pairs, EDGES), "leaf-edges")
    near = F.abs(F.col("s") - threshold) < 1e-4
    ends = lambda c: nodes.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    doubtful = found.filter(near).select("a", "b").distinct().join(ends("a"), "a").join(ends("b"), "b")

    def exact(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                yield b.column("a"), b.column("b"), (matrix(b.column("va"), dim) * matrix(b.column("vb"), dim)).sum(1)

    return found.filter(~near).unionByName(map_rows(doubtful, exact, EDGES))


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node among edges (a, b, s, old), an edge being old if it was before."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return once.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def descend(nodes: DataFrame, graph: DataFrame, dim: int, k: int) -> DataFrame:
    """Pairs of neighbours of a node, one of them new, that are nearer than the worst in a full list of theirs."""
    worst = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(-1.0).alias("worst"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "old").withColumn("r", rank).filter(F.col("r") <= k).drop("r")
    around = graph.select("a", "b", "s", "old").unionByName(back).groupBy("a", "b").agg(F.min("old").alias("old"))
    fresh = around.filter("old = 0").select("a").distinct()
    members = (
        around.join(fresh, "a", "left_semi").join(worst.withColumnRenamed("a", "b"), "b", "left")
        .join(nodes.select(F.col("id").alias("b"), "v"), "b")
        .select("a", "b", "old", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "v")
        .repartition("a").sortWithinPartitions("a")
    )

    def pairs(batches: Iterator[pa.RecordBatch]):
        for g in groups(batches, 1):
            ids, old, worst = (g.column(c).to_numpy() for c in ("b", "old", "worst"))
            x = matrix(g.column("v").combine_chunks(), dim)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            row, col = np.nonzero((s > worst[:, None]) & ((old[:, None] == 0) | (old[None] == 0)))
            yield ids[row], ids[col], s[row, col]

    return map_rows(members, pairs, EDGES)


def complete(nodes: DataFrame, classes: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """id, links (weight of the nodes above the threshold) within classes (id, component), compared in blocks."""
    member = nodes.join(classes, "id").select("component", "id", "n", "v")
    sizes = classes.groupBy("component").count().select("component", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = member.join(sizes, "component").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    asked = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "component", "part", "other", F.lit(0).alias("side"), "id", "n", "v")
    found = dealt.withColumn("mine", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "component", F.col("mine").alias("part"), F.col("part").alias("other"), F.lit(1).alias("side"), "id", "n", "v")
    both = asked.unionByName(found).repartition("component", "part", "other").sortWithinPartitions("component", "part", "other", "side")

    def rows(batches: Iterator[pa.RecordBatch]):
        for g in groups(batches, 3):
            x, side, n, ids = matrix(g.column("v").combine_chunks(), dim), *(g.column(c).to_numpy() for c in ("side", "n", "id"))
            q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            links = np.zeros(len(q), np.int64)
            for i in range(0, len(q), 512):
                near = (x[q[i : i + 512]] @ x[c].T >= threshold) & (ids[q[i : i + 512], None] != ids[None, c])
                links[i : i + 512] = near @ n[c]
            yield ids[q], links

    return map_rows(both, rows, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, links: DataFrame, exact: DataFrame, dim: int, threshold: float, size: int) -> float:
    """Mean share of its true links that a node with any has found, among ``size`` nodes (of smallest hashed id).

    Nodes of components that were compared in whole (``exact``: id) are left out: they are right, and their many links
    would hide what others miss.
    """
    rest = nodes.join(exact, "id", "left_anti")
    asked = rest.orderBy(F.xxhash64("id"), "id").limit(size).collect()
    if not asked:
        return 1.0
    x = np.stack([np.frombuffer(r.v, "<f8") for r in asked])
    shared = nodes.sparkSession.sparkContext.broadcast((x, np.array([r.id for r in asked])))

    def rows(batches: Iterator[pa.RecordBatch]):
        q, ids = shared.value
        total = np.zeros(len(q), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                near = (q @ matrix(part.column("v"), dim).T >= threshold) & (ids[:, None] != part.column("id").to_numpy()[None])
                total += near @ part.column("n").to_numpy()
        yield ids, total

    true = map_rows(nodes.select("id", "n", "v"), rows, "id long, t long").groupBy("id").agg(F.sum("t").alias("t")).filter("t > 0")
    share = F.least("t", F.coalesce("links", F.lit(0))) / F.col("t")
    found = true.join(links, "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if found is None else found


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, k: int = 8, floor: float = 0.5, rounds: int = 6, missed: float = 0.03,
    recall: float = 0.95, tries: int = 6, audited: int = 2048, block: int = 2048, seed: int = 11,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vec_id of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are kept.  Rows
    without an id are left out; of rows that share an id the valid vector of smallest bytes stands.  Other
    columns are ignored; an empty table gives no rows.  All vectors must have one dimension.

    ``floor``: similarity below which a neighbour is not followed; ``k``: length of a list at first, doubled
    with every new try; ``missed``: share of lone pairs at the threshold that the tables of one try may miss; ``recall``: what
    the audit of ``audited`` nodes asks for.  Where ``tries`` tries do not reach it, a warning says so.
    """
    ids = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    rows = materialize(valid_vectors(vectors).groupBy("vec_id").agg(F.min("v").alias("raw")), "vectors")
    first = rows.select("raw").first()
    if first is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = len(first[0]) // 8

    def unit(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("raw"), dim)
                x = x / np.abs(x).max(1)[:, None]
                x = x / np.sqrt((x * x).sum(1))[:, None]
                yield b.column("id"), b.column("n"), [r.tobytes() for r in x]

    equal = rows.groupBy("raw").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(map_rows(equal.select("id", "n", "raw"), unit, "id long, n long, v binary"), "nodes")
    n = nodes.count()
    graph = nodes.sparkSession.createDataFrame([], EDGES + ", old int")
    for attempt in range(tries):
        start = leaves(nodes, n, dim, k, floor, threshold, missed, seed + attempt).withColumn("old", F.lit(0))
        graph = materialize(nearest(graph.unionByName(start), k), "graph")
        for _ in range(rounds):
            more = descend(nodes, graph, dim, k).filter(F.col("s") >= floor).withColumn("old", F.lit(0))
            graph = materialize(nearest(graph.withColumn("old", F.lit(1)).unionByName(more), k), "graph")
            if graph.filter("old = 0").count() <= n // 1000:
                break
        links = graph.filter(F.col("s") >= threshold)
        classes = materialize(components(links.select("a", "b")).withColumnRenamed("node", "id"), "classes")
        full = links.groupBy("a").count().filter(F.col("count") >= k).select(F.col("a").alias("id"))
        dense = classes.join(full, "id", "left_semi").select("component").distinct()
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        listed = both.join(nodes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
        spread = complete(nodes, classes.join(dense, "component", "left_semi").select("id", "component"), dim, threshold, block)
        counted = materialize(listed.join(spread.select("id"), "id", "left_anti").unionByName(spread), "links")
        reached = audit(nodes, counted, spread.select("id"), dim, threshold, audited)
        if reached >= recall:
            break
        k *= 2
    else:
        warnings.warn(f"near_vectors found {reached:.3f} of the audited links, {recall} were asked for", stacklevel=2)
    found = nodes.select("id", "n").join(classes, "id", "left").join(counted, "id", "left").select(
        "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = rows.join(equal.select("raw", "id"), "raw").select("vec_id", "id").join(found, "id").drop("id")
    return ids.join(named, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
