"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints within the distance agree in some segment up to that
segment's radius, as long as the radii plus one sum to more than the distance.  Each segment has a table of
its values; every fingerprint enumerates the Hamming ball around its own value there, fetches the matches and
verifies the complete distance.  Equal fingerprints are one entry from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, materialize, one_row_each, texts
from .components import components, roots

#: (first bit, bits, radius)
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Table rows of one segment value that a task compares at a time; more are split into blocks.
BLOCK_ROWS = 4096


def fingerprint(text: bytes, words: int = 4) -> int:
    """Signed 64-bit fingerprint over XXH64 (seed 42) of word shingles, repeats included."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    joined, size = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, len(w) - words + 1)]
    ends = ends[min(words, len(w)) - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), 32_768):
        pairs = zip(starts[i : i + 32_768].tolist(), ends[i : i + 32_768].tolist())
        raw = b"".join([digest(joined[a:z], 42) for a, z in pairs])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp of whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield [b.column("doc_id"), [fingerprint(t.as_buffer().to_pybytes(), words) for t in b.column("text")]]

    return map_rows(texts(docs), rows, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """Differences of up to ``radius`` of ``bits`` bits."""
    return np.array(
        [sum(1 << i for i in on) for r in range(radius + 1) for on in combinations(range(bits), r)], np.uint64
    )


def segment_rows(entries: DataFrame, segments, probe: bool) -> DataFrame:
    """One row for each entry (fp, rep) and segment value: its own ones, or those of the balls around them."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                fp, rep = part.column("fp").to_numpy(), part.column("rep").to_numpy()
                keys = []
                for k, (at, bits, radius) in enumerate(segments):
                    own = (fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << bits) - 1)
                    near = own[:, None] ^ ball(bits, radius if probe else 0)[None]
                    keys.append(near | np.uint64(k << 40))
                keys = np.concatenate(keys, axis=1)
                n = keys.shape[1]
                yield [keys.ravel().view(np.int64), np.repeat(fp, n), np.repeat(rep, n)]

    return map_rows(entries.select("fp", "rep"), rows, "key long, fp long, rep long")


def links(entries: DataFrame, distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """Edges (a, b) between reps of fingerprints within ``distance``, enough to connect all that are linked.

    Of the links found under one segment value, a spanning forest is returned, so a dense group costs as many
    rows as it has members.  Values shared by many entries are split into blocks of table rows, and their
    probes go to every block.
    """
    if sum(r + 1 for _, _, r in segments) <= distance:
        raise ValueError("the radii leave some pairs out")
    table = segment_rows(entries, segments, False)
    hot = (
        table.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS)
        .select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    hot = materialize(hot, "hot-keys")
    held = (
        table.join(hot, "key", "left")
        .select("key", F.expr("coalesce(pmod(xxhash64(fp), blocks), 0)").alias("block"), F.lit(0).alias("probe"), "fp", "rep")
    )
    asked = (
        segment_rows(entries, segments, True).join(hot, "key", "left")
        .select("key", F.explode(F.expr("sequence(0L, coalesce(blocks, 1) - 1L)")).alias("block"), F.lit(1).alias("probe"), "fp", "rep")
    )
    both = held.unionByName(asked).repartition("key", "block").sortWithinPartitions("key", "block", "probe")

    def rows(batches: Iterator[pa.RecordBatch]):
        rest = [np.zeros(0, np.int64)] * 5  # table rows of the group that the last batch ended in
        for b in batches:
            cols = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns)]
            key, block, probe, fp, rep = cols
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            sizes = np.bincount(group[probe == 0], minlength=len(first))
            last = slice(first[-1], first[-1] + sizes[-1])
            rest = [c[last].copy() for c in cols]
            asks = np.flatnonzero((probe == 1) & (sizes[group] > 0))
            n = sizes[group[asks]]
            todo, at = np.cumsum(n), 0
            while at < len(asks):  # about four million comparisons at a time
                end = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + 4_000_000, "right")))
                p, m = asks[at:end], n[at:end]
                left = np.repeat(p, m)
                right = np.repeat(first[group[p]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                u = fp.view(np.uint64)
                ok = (np.bitwise_count(u[left] ^ u[right]) <= distance) & (rep[left] != rep[right])
                if ok.any():
                    node, root = roots(rep[left[ok]], rep[right[ok]])
                    own = node != root
                    yield [node[own], root[own]]
                at = end

    return map_rows(both, rows, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Words are runs of non-space ASCII after lower-casing A-Z; null text is empty and has fingerprint zero,
    which links like any other.  Rows that share a doc_id are one document to the components; rows without a
    doc_id have no component.  Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    entries = materialize(
        prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-entries"
    )
    ids = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y")
    # rows of one doc_id with several fingerprints connect these
    same = (
        prints.join(ids.select("doc_id"), "doc_id", "left_semi").join(entries, "fp")
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    found = components(links(entries, distance, segments).unionByName(same))
    classes = entries.join(found, entries.rep == found.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, of the smallest doc_id of each component, one row each.

    Of rows that share a doc_id ``common.one_row_each`` says which stays; rows without one stay all.
    """
    first = near_duplicates(docs, **options).filter("doc_id = component_id").select("doc_id").distinct()
    kept = one_row_each(docs.join(first, "doc_id", "left_semi"))
    return kept.unionByName(docs.filter("doc_id is null"))
