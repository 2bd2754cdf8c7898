"""Near copies by exact similarity of word shingles.

Documents of at least the similarity (Jaccard, of the sets of word shingles) are linked.  Candidates come from SimHash
fingerprints of the same shingles, which differ in few bits where texts are nearly equal, and then, as a pair of similarity
0.8 differs in more bits than can be looked up, from bands of minimum hashes; with BANDS bands of ROWS hashes such a pair
shares none with a chance of 3e-6.  Every candidate is measured on its whole shingle sets, so no link is wrong.

Pairs that links already connect need no measuring: SimHash links come first, then each bucket's members are measured against one of them first, in
a few rounds, and only members of different components of what was found are then compared with each other, small
buckets as pairs and large ones block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, materialize, one_row_each, texts
from .components import components
from .embed_dedup import groups
from .simhash import fingerprint, links

BANDS, ROWS = 32, 5
#: Rounds that measure the members of a bucket against one of them.
STARS = 2
#: Members of a bucket whose pairs are listed; larger ones are compared in blocks.
FEW, BLOCK = 16, 256


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of word shingles; a shorter text is one shingle, an empty one has none."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, len(w) - words + 1)]
    ends = ends[min(words, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts.tolist(), ends.tolist())
    return np.unique(np.fromiter((digest(joined[a:z], 42) for a, z in pairs), np.uint64, len(starts)))


def bands(x: np.ndarray) -> list[int]:
    """Hashes of the bands of minimum hashes of a set."""
    import xxhash

    draw = np.random.default_rng(5).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(x), 1024):
        low = np.minimum(low, ((x[i : i + 1024, None] ^ draw[0]) * (draw[1] | np.uint64(1))).min(0))
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - 2**63 for k, r in enumerate(low.reshape(BANDS, ROWS))]


def set_id(x: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63


def alike(a: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` are at least so similar to ``a``; all are sorted sets that are not empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat(a[at] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= similarity * (len(a) + sizes - both) - 1e-9


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, id (of the shingle set), keys (of its bands), fp (SimHash fingerprint)."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            whole = [t.as_buffer().to_pybytes() for t in b.column("text")]
            sets = [shingles(t, words) for t in whole]
            yield [b.column("doc_id"), [set_id(x) for x in sets], [bands(x) if len(x) else [] for x in sets],
                   [fingerprint(t, words) for t in whole]]

    return map_rows(texts(docs), rows, "doc_id long, id long, keys array<long>, fp long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, x (the set as bytes) of the wanted sets (id, doc_id)."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                sets = [shingles(t.as_buffer().to_pybytes(), words) for t in part.column("text")]
                yield [[set_id(x) for x in sets], part.column("id"), [x.tobytes() for x in sets]]

    asked = texts(docs).join(wanted.select("doc_id", "id"), "doc_id")
    made = map_rows(asked.select("id", "text"), rows, "own long, id long, x binary").filter("own = id")
    return made.select("id", "x").dropDuplicates(["id"])


def simhash_pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of ``entries`` (id, fp) whose fingerprints SimHash links; ids of one fingerprint pair with its first."""
    first = entries.groupBy("fp").agg(F.min("id").alias("rep"))
    equal = entries.join(first, "fp").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return equal.unionByName(links(first).select("a", "b")).distinct()


def measured(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough; an ``a`` of many pairs goes to several tasks."""
    sizes = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / BLOCK).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.expr("pmod(xxhash64(b), parts)"))
    own = sizes.select("a", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part")).join(
        sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "x")
    others = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "x")
    both = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def rows(batches: Iterator[pa.RecordBatch]):
        mine = None
        for batch in batches:
            found = [], []
            for a, side, b, x in zip(*(batch.column(c) for c in ("a", "side", "b", "x"))):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if side.as_py() == 0:
                    mine = x.copy()
                elif alike(mine, [x], similarity)[0]:
                    found[0].append(a.as_py())
                    found[1].append(b.as_py())
            yield found

    return map_rows(both, rows, "a long, b long")


def blockwise(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Links between members (key, id, component) of a bucket in different components, enough to connect these."""
    sizes = members.groupBy("key").count().select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(sizes, "key").withColumn("mine", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    sent = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).join(sets, "id").select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "component", "x")
    ordered = sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def rows(batches: Iterator[pa.RecordBatch]):
        for g in groups(batches, 3):
            i, j, mine, ids, label = (g.column(c).to_numpy().copy() for c in ("i", "j", "mine", "id", "component"))
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("x")]
            size = np.array([len(x) for x in sets_])
            within, found = i[0] == j[0], ([], [])
            for p in np.flatnonzero(mine == i[0]):
                ok = (label != label[p]) & (np.minimum(size, size[p]) >= similarity * np.maximum(size, size[p]) - 1e-9)
                ok &= (np.arange(len(ids)) > p) if within else (mine == j[0])
                near = np.flatnonzero(ok)
                if len(near):
                    for q in near[alike(sets_[p], [sets_[q] for q in near], similarity)]:
                        if label[q] != label[p]:
                            found[0].append(ids[p])
                            found[1].append(ids[q])
                            label[label == label[q]] = label[p]
            yield found

    return map_rows(ordered, rows, "a long, b long")


def divided(members: DataFrame, edges: DataFrame) -> DataFrame:
    """key, id, component, size of the buckets (key, id) whose members are not all connected yet."""
    classes = components(edges).withColumnRenamed("node", "id")
    placed = materialize(members.join(classes, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    differ = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    return materialize(placed.join(differ.select("key", "size"), "key"), "open-buckets")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, with all their columns, of the smallest doc_id of each group of near copies, one row each.

    A group is connected by links of at least ``similarity``.  Words are runs of non-space ASCII after lower-casing
    A-Z.  Null text is empty, and empty texts are copies of each other.  Rows that share a doc_id are one document, of which
    ``common.one_row_each`` says the row that stays;
    rows without a doc_id stay.
    """
    known = docs.filter("doc_id is not null")
    signed = materialize(signatures(known, words), "signatures")
    entries = materialize(
        signed.groupBy("id").agg(F.min(F.struct("doc_id", "keys", "fp")).alias("m")).select("id", "m.*"), "shingle-sets")
    repeated = signed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z")
    same = signed.join(repeated, "doc_id").select("a", F.col("id").alias("b"))
    members = entries.select("id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key")
    members = materialize(members.join(shared, "key", "left_semi"), "buckets")
    close = materialize(simhash_pairs(entries.filter(F.size("keys") > 0)), "simhash-pairs")
    compared = members.select("id").unionByName(close.select(F.col("a").alias("id"))).unionByName(close.select(F.col("b").alias("id")))
    sets = materialize(sets_of(known, entries.join(compared.distinct(), "id", "left_semi"), words), "sets")
    edges = materialize(same.unionByName(measured(sets, close, similarity)), "links")
    open_ = divided(members, edges)
    for star in range(STARS):
        centre = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(star)), "id", "component")).alias("c"))
        pairs = open_.join(centre, "key").filter("component <> c.component").select(F.col("c.id").alias("a"), F.col("id").alias("b"))
        edges = edges.unionByName(materialize(measured(sets, pairs.distinct(), similarity), "links"))
        open_ = divided(members, edges)
    few = open_.filter(F.col("size") <= FEW)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, F.expr("a.key = b.key and a.id < b.id and a.component <> b.component")).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    edges = edges.unionByName(materialize(measured(sets, pairs, similarity), "links")).unionByName(
        materialize(blockwise(sets, open_.filter(F.col("size") > FEW), similarity), "links"))
    classes = components(edges).withColumnRenamed("node", "id")
    first = entries.select("id", "doc_id").join(classes, "id", "left").groupBy(
        F.coalesce("component", "id").alias("component")).agg(F.min("doc_id").alias("doc_id"))
    kept = one_row_each(docs.join(first, "doc_id", "left_semi"))
    return kept.unionByName(docs.filter("doc_id is null"))
