"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, materialize

#: Edges that a task joins up at a time.
CHUNK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node each is connected with by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def thin(edges: DataFrame) -> DataFrame:
    """Edges of the same components, at most one for each node and chunk of a partition."""

    def rows(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done():
            node, root = roots(*(np.concatenate(c) for c in zip(*held)))
            own = node != root
            return [node[own], root[own]]

        for b in batches:
            if b.num_rows:
                held.append((b.column("a").to_numpy(), b.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) >= CHUNK:
                yield done()
                held = []
        if held:
            yield done()

    return map_rows(edges.select("a", "b"), rows, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges (a, b); loops and repeats do no harm.

    Rounds of large-star and small-star, which end after about the logarithm of the longest path; each is
    written to the shared folder.  A star with many rays is summed before it is shuffled, and its join back is
    one that adaptive execution can split.
    """
    stars = materialize(thin(edges.filter("a <> b")), "components")
    state = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        # large-star: every larger neighbour moves to the smallest node around
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(thin(small.unionByName(low.select("a", F.col("m").alias("b")))).distinct(), "components")
    ends = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tops = ends.select(F.col("component").alias("node"), "component").distinct()
    return ends.unionByName(tops)
