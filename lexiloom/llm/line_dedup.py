"""Line deduplication by pairwise alignment.

Documents that share a rare line (held by few documents) are paired with each other; a line that many hold
pairs each of them with the first holder alone, so it costs as many pairs as it has holders.  A pair is
aligned by patience diff: the lines that both have once give the longest chain in the same order, and the
gaps of the chain are filled in the same way from lines that repeat.  Aligned lines that stand together in the
later document form blocks, and blocks of enough words are deleted from it.

The first document that holds a line keeps it: a line goes only where an earlier document has it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, materialize

#: A line is rare if at most so many documents hold it.
RARE = 8
#: Words of the shortest block that is deleted.
MIN_WORDS = 30


def lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines: doc, th (hash of the text), rank (among non-blank lines), line (number), h, words."""

    def rows(batches: Iterator[pa.RecordBatch]):
        import xxhash

        for b in batches:
            out = [[] for _ in range(6)]
            for doc, th, text in zip(*(b.column(c).to_pylist() for c in ("doc", "th", "text"))):
                rank = 0
                for i, line in enumerate(text.split("\n")):
                    words = line.split()
                    if words:
                        h = xxhash.xxh64_intdigest(" ".join(words).encode()) - 2**63
                        for c, v in zip(out, (doc, th, rank, i, h, len(words))):
                            c.append(v)
                        rank += 1
                if len(out[0]) > 100_000:
                    yield out
                    out = [[] for _ in range(6)]
            yield out

    return map_rows(docs, rows, "doc long, th long, rank int, line int, h long, words int")


def longest_chain(later: list[int], earlier: list[int]) -> list[int]:
    """Indices of a longest run of pairs that rise in both; ``later`` rises already."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(later)
    for i, e in enumerate(earlier):
        k = bisect_left(tops, e)
        if k == len(tops):
            tops.append(e)
            at.append(i)
        else:
            tops[k], at[k] = e, i
        back[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(rows: list[tuple[int, int, bool]]) -> list[int]:
    """Patience diff of one pair: ranks in the later document that are aligned.

    rows: rank in the later document, rank in the earlier one, whether the line is there once in both; in
    order of the first.  Lines that repeat are numbered, and their first, second and so on are matched.
    """
    once = [r for r in rows if r[2]]
    chain = [once[i][:2] for i in longest_chain([r[0] for r in once], [r[1] for r in once])]
    out = [r for r, _ in chain]
    more = [r for r in rows if not r[2]]
    if more:
        bounds = [(-1, -1), *chain, (2**31, 2**31)]
        k, gap = 0, []
        for r in [*more, None]:
            while r is None or r[0] > bounds[k + 1][0]:
                out += [gap[i][0] for i in longest_chain([g[0] for g in gap], [g[1] for g in gap])]
                gap, k = [], k + 1
                if k + 1 >= len(bounds):
                    break
            if r is not None and bounds[k][1] < r[1] < bounds[k + 1][1]:
                gap.append(r)
    return out


def aligned_blocks(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, th, gone (for each line up to the last to delete, whether it goes) for documents (doc, th, text) that have such lines."""
    every = materialize(lines(docs).distinct(), "lines")  # rows that repeat id and text are one document
    key = F.struct("doc", "th")
    held = every.groupBy("h").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi").select("h")
    same = Window.partitionBy("doc", "th", "h")
    shared = every.join(held, "h", "left_semi").select(
        "*", F.row_number().over(same.orderBy("rank")).alias("nth"), (F.count(F.lit(1)).over(same) == 1).alias("once")
    )
    shared = materialize(shared, "shared-lines")
    holders = shared.groupBy("h", "nth").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc", "th", "rank", "once")).alias("first"))
    later = shared.join(holders, ["h", "nth"])
    columns = ("doc", "th", "rank", "line", "words")
    common = later.filter((F.col("docs") > rare) & (F.struct("doc", "th") > F.struct("first.doc", "first.th"))).select(
        *columns, F.col("first.doc").alias("doc0"), F.col("first.th").alias("th0"), F.col("first.rank").alias("rank0"),
        (F.col("once") & F.col("first.once")).alias("once"))
    few = later.filter(F.col("docs").between(2, rare)).drop("first", "docs")
    a, b = few.alias("a"), few.alias("b")
    close = b.join(a, (F.col("a.h") == F.col("b.h")) & (F.col("a.nth") == F.col("b.nth"))
                   & (F.struct("a.doc", "a.th") < F.struct("b.doc", "b.th"))).select(
        *(F.col(f"b.{c}") for c in columns), F.col("a.doc").alias("doc0"), F.col("a.th").alias("th0"),
        F.col("a.rank").alias("rank0"), (F.col("a.once") & F.col("b.once")).alias("once"))
    pairs = common.unionByName(close).repartition("doc", "th").sortWithinPartitions("doc", "th", "doc0", "th0", "rank")

    def rows(batches: Iterator[pa.RecordBatch]):
        doc = pair = None
        matches: list[tuple[int, int, bool]] = []
        of: dict[int, tuple[int, int]] = {}
        found: set[int] = set()

        def blocks():
            gone, run = [], []
            for r in [*sorted(found), None]:
                if run and (r is None or r != run[-1] + 1):
                    if sum(of[x][1] for x in run) >= min_words:
                        gone += [of[x][0] for x in run]
                    run = []
                run.append(r)
            mask = [False] * (gone[-1] + 1 if gone else 0)
            for line in gone:
                mask[line] = True
            return mask

        out = [[], [], []]
        for b in batches:
            for d, th, rank, line, words, d0, th0, rank0, once in zip(*(c.to_pylist() for c in b.columns)):
                if (d, th, d0, th0) != pair:
                    found.update(align(matches))
                    matches, pair = [], (d, th, d0, th0)
                if (d, th) != doc:
                    if doc and (gone := blocks()):
                        for c, v in zip(out, (*doc, gone)):
                            c.append(v)
                    of, found, doc = {}, set(), (d, th)
                of[rank] = (line, words)
                matches.append((rank, rank0, once))
            yield out
            out = [[], [], []]
        found.update(align(matches))
        if doc and (gone := blocks()):
            yield [[doc[0]], [doc[1]], [gone]]

    return map_rows(pairs, rows, "doc long, th long, gone array<boolean>")


def drop_repeats(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns and rows, ``text`` without the blocks that an earlier document has.

    Adds line_dedup_lines and line_dedup_gone (lines before, lines deleted).  Documents are ordered by doc_id,
    null ids first, and by a hash of the text where ids repeat; rows that repeat both are one document and
    are treated alike.  Null text stays null; a text all of whose lines go becomes empty.  Lines are compared
    by their words, so blanks at their ends do not matter.
    """
    keyed = docs.withColumn("line_dedup_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(
        "line_dedup_th", F.xxhash64("text"))
    given = keyed.filter("text is not null").select(
        F.col("line_dedup_doc").alias("doc"), F.col("line_dedup_th").alias("th"), "text")
    blocks = materialize(aligned_blocks(given, rare, min_words), "blocks").select(
        F.col("doc").alias("line_dedup_doc"), F.col("th").alias("line_dedup_th"), F.col("gone").alias("line_dedup_gone"))
    # the same join at every size: blocks grow with the documents, so a broadcast of them would not last
    joined = keyed.join(blocks.hint("merge"), ["line_dedup_doc", "line_dedup_th"], "left")
    parts = F.split("text", "\n")
    gone = F.col("line_dedup_gone")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False))), "\n")
    return joined.select(
        *(F.when(gone.isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`")
          for c in docs.columns),
        F.size(parts).alias("line_dedup_lines"), F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).alias("line_dedup_gone"),
    )
