"""Best-fit packing of token sequences by patterns fitted to the length histogram.

1. Whole texts are encoded and cut into pieces; each piece gets its rank among the equally long ones.
2. The histogram of piece lengths (at most ``capacity`` numbers, however large the input) is covered with
   patterns of up to three lengths that fill a sequence: non-negative least squares fits how often each
   pattern repeats, the counts are rounded down to what the histogram holds, and what is left over is packed
   best-fit, longest first, by counts of equal lengths.
3. The resulting list of patterns goes back to the pieces: a piece's rank among its length names its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, materialize, texts
from .encoding import encoder, share_file, tokenizer_file

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def cut_pieces(docs: DataFrame, end_id: int, capacity: int, tokenizer: str | None) -> DataFrame:
    """Encoded pieces with ``part`` (the partition) and ``nth`` (rank among its equally long pieces there)."""
    definition = share_file(docs.sparkSession, tokenizer_file(tokenizer, "byte_bpe_50k.json"))
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out = [[] for _ in range(7)]
            ids = encoder(definition, "leading").encode(b.column("text"))
            for doc, x in zip(b.column("doc_id").to_pylist(), ids):
                data = x.as_buffer().to_pybytes() + end
                n = len(data) // 4
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], n])):
                    for c, v in zip(out, (doc, k, a, z - a, data[4 * a : 4 * z], part, int(seen[z - a]))):
                        c.append(v)
                    seen[z - a] += 1
            yield out

    return map_rows(docs, rows, PIECES)


def fill_patterns(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """Full patterns of one, two or three lengths that occur (rows of three, zero for none)."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    out = [(capacity, 0, 0)] if has[capacity] else []
    a = lengths[lengths * 2 >= capacity]
    out += [(int(x), capacity - int(x), 0) for x in a if x < capacity and has[capacity - x]]
    for x in lengths[lengths * 3 >= capacity]:
        y = np.arange(-(-(capacity - x) // 2), min(int(x), capacity - int(x) - 1) + 1)
        z = capacity - x - y
        ok = has[y] & has[z] & (z > 0)
        out += list(zip([int(x)] * int(ok.sum()), y[ok].tolist(), z[ok].tolist()))
    return np.array(out, np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram, by accelerated projected gradients.

    Lengths are weighted so that long pieces, which little else can use, are met first; weights are 1 to 2.
    """
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    weight = 1 + np.arange(size) / size
    weight[0] = 0

    def times(x):
        return sum(np.bincount(patterns[:, j], x, size) for j in range(3)) * weight

    def back(r):
        r = r * weight
        return r[patterns].sum(1)

    target = histogram * weight
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(times(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - target) / (norm * 1.02))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan_sequences(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) rows that use every piece of the histogram exactly once.

    There are as many rows as patterns and left-over shapes, whatever the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, list[int]]] = []
    patterns = fill_patterns(capacity, np.flatnonzero(left))
    wanted = fit_counts(patterns, left)
    for i in np.argsort(-wanted, kind="stable"):
        if wanted[i] < 0.5:
            break
        lengths = [int(v) for v in patterns[i] if v]
        need = np.bincount(lengths, minlength=len(left))
        used = np.flatnonzero(need)
        n = int(min(round(wanted[i]), (left[used] // need[used]).min()))
        if n > 0:
            left -= n * need
            plan.append((n, lengths))
    # best fit, longest first, for equal lengths at a time: open holds (lengths, count) by free space
    open_: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            space = min((s for s, rows in open_.items() if s >= length and rows), default=None)
            if space is None:
                fit = capacity // length
                whole, rest = divmod(n, fit)
                for repeats, k in ((whole, fit), (1, rest)):
                    if repeats and k:
                        open_.setdefault(capacity - k * length, []).append([[length] * k, repeats])
                break
            lengths, count = open_[space].pop()
            fit = min(space // length, n)
            take = min(count, n // fit)
            if take < count:
                open_[space].append([lengths, count - take])
            open_.setdefault(space - fit * length, []).append([lengths + [length] * fit, take])
            n -= take * fit
    for rows in open_.values():
        plan += [(count, lengths) for lengths, count in rows if count]
    return plan


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, part and nth, which rank them) with sequence_id and offset.

    Only what is asked of ``pieces`` moves: leave the ids out where a digest of them will do.
    """
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = counts.select("part", "length", earlier.alias("earlier"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # capacity rows at most
        histogram[length] = n
    # slots of each length, in plan order: ranks from `first` on take slot `at` of sequences from `sequence` on
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    filled, sequence = np.zeros(capacity + 1, np.int64), 0
    for repeats, lengths in plan_sequences(histogram, capacity):
        at = 0
        for length in lengths:
            slots[length].append((int(filled[length]), sequence, at))
            filled[length] += repeats
            at += length
        sequence += repeats
    table = pieces.sparkSession.sparkContext.broadcast([np.array(s, np.int64).reshape(-1, 3) for s in slots])

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                of, s = length == v, table.value[v]
                k = np.searchsorted(s[:, 0], rank[of], "right") - 1
                seq[of], at[of] = s[k, 1] + rank[of] - s[k, 0], s[k, 2]
            yield [*b.columns[:-1], seq, at]

    ranked = pieces.join(offsets, ["part", "length"]).select(
        *pieces.drop("part", "nth").columns, (F.col("earlier") + F.col("nth")).alias("rank")
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return map_rows(ranked, rows, f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, end_id: int = 2, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids, sequence_id, offset.

    Null text is empty and gives the end id alone; only documents of more than ``capacity`` ids are cut, the
    first piece being the short one.  Repeated and null doc_ids are packed like any others; other columns are
    ignored; an empty table gives no rows.
    """
    return place(materialize(cut_pieces(texts(docs), end_id, capacity, tokenizer), "pieces"), capacity)


def packed_digests(docs: DataFrame, end_id: int = 2, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``pack`` with a checksum of each piece's ids in their place."""
    pieces = materialize(cut_pieces(texts(docs), end_id, capacity, tokenizer), "pieces")
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per packed sequence: sequence_id, doc_ids, lengths, ids (at most ``capacity`` of them)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.col("r.doc_id").alias("doc_ids"), F.col("r.length").alias("lengths"),
        F.aggregate("r.ids", F.to_binary(F.lit("")), lambda a, x: F.concat(a, x)).alias("ids"),
    )
