"""Language model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of up to two preceding words.  A context's continuations are stored if their share
of all training tokens is at least ``least``, which bounds a level of the tree by 1 / least entries whatever the
corpus (the lower bound on a context's probability is part of the model, as usual for these trees).  A context is
retained if its distribution diverges from that of its suffix.  A stored continuation counts one less than it
was seen, and what that frees, with all that is not stored, goes to the suffix's distribution:

    P(w | s) = (c(s, w) - 1) / N(s) + m(s) P(w | suffix of s),    m(s) = 1 - sum of (c(s, w) - 1) / N(s)

Each token is scored in the longest retained suffix of what precedes it.  The empty context has the base
distribution (c + 1) / (N + V + 1) over all words, seen or not.  Symbols of the tree are the most frequent words, the
end, and one class for all rarer words; within that class words keep their base probabilities, whose counts
come from a join with the whole vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, materialize, once_per_worker, texts
from .encoding import SLICE_BYTES

#: Words with a symbol of their own, at most; after them come the rare class, the end, and the start of a text.
SYMBOLS = 1 << 17
RARE, END, START, SIZE = SYMBOLS, SYMBOLS + 1, SYMBOLS + 2, 1 << 18
LEAST = 5e-7
DIVERGENCE = 0.02
FLUSH = 3_000_000


def slices(texts_: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts_).to_numpy(zero_copy_only=False)) if len(texts_) else np.zeros(0)
    at = 0
    while at < len(texts_):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, end
        at = end


def words_of(texts_: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order (A-Z lower), and how many each text has."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts_), r"[\x20\x09-\x0D]+")
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(before[starts])


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over ``docs`` (doc_id, text); the end is the null word."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for s, e in slices(b.column("text")):
                words, _ = words_of(b.column("text").slice(s, e - s))
                found = pc.value_counts(words)
                yield [pa.concat_arrays([found.field("values"), pa.array([None], pa.string())]),
                       pa.concat_arrays([found.field("counts"), pa.array([e - s], pa.int64())])]

    return map_rows(docs, rows, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Tree:
    """Symbols, base probabilities, and for each level sorted contexts and continuations."""

    def __init__(self, words: list[str], base: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
        self.words, self.base, self.levels = words, base, levels
        self.digest = hashlib.sha256("\n".join(words).encode()).hexdigest()  # words hold no line feed

    def symbols(self, words: pa.Array) -> np.ndarray:
        known = once_per_worker(("symbols", self.digest), lambda: pa.array(self.words, pa.string()))
        return pc.fill_null(pc.index_in(words, known), RARE).to_numpy(zero_copy_only=False).astype(np.int64)

    def chance(self, context: np.ndarray, w: np.ndarray, level: int) -> np.ndarray:
        """P(w | context), a context being its symbols as digits, and the last ``level`` of them in use."""
        if level == 0:
            return self.base[w]
        p = self.chance(context % SIZE ** (level - 1), w, level - 1)
        if level > len(self.levels):
            return p
        contexts, rest, keys, extra = self.levels[level - 1][:4]
        if not len(contexts):
            return p
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        own = np.flatnonzero(contexts[at] == context)
        key = context[own] * SIZE + w[own]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        p[own] = np.where(keys[k] == key, extra[k], 0.0) + rest[at[own]] * p[own]
        return p


def sequence(tree: Tree, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Symbols of all texts, an end after each; tokens of each text; the words."""
    words, sizes = words_of(texts_)
    out = np.full(len(words) + len(sizes), END, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = tree.symbols(words)
    return out, sizes + 1, words


def contexts_of(symbols: np.ndarray, sizes: np.ndarray, level: int) -> np.ndarray:
    """The ``level`` symbols before each token, as digits; START stands before a text."""
    position = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros(len(symbols), np.int64)
    for back in range(level, 0, -1):
        before = np.concatenate([np.full(back, START), symbols[:-back]])[: len(symbols)]
        out = out * SIZE + np.where(position >= back, before, START)
    return out


def planes(values: np.ndarray) -> bytes:
    """Compressed numbers, byte by byte of their places."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unplane(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def spread(context: np.ndarray, buckets: int) -> np.ndarray:
    return ((context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def grow(docs: DataFrame, shared, level: int, total: int, least: float, divergence: float) -> tuple[np.ndarray, ...]:
    """One more level of the tree: contexts, m, keys and (c - 1) / N of those that diverge from their suffix.

    Counts of a partition are summed there and travel as packed numbers; a context's counts meet in one bucket,
    whose numbers are summed as they come.  ``docs``: training documents.
    """
    buckets = int(np.clip(total // 2_000_000, 1, 4096))
    fewest = int(np.ceil(least * total))

    def count(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def packed():
            keys, counts = summed(all_ := np.concatenate(held), np.ones(len(all_), np.int64))
            where = spread(keys // SIZE, buckets)
            for k in np.unique(where):
                own = where == k
                yield [[k], [planes(np.diff(keys[own], prepend=0))], [planes(counts[own])]]

        for b in batches:
            for s, e in slices(b.column("text")):
                symbols, sizes, _ = sequence(shared.value, b.column("text").slice(s, e - s))
                context = contexts_of(symbols, sizes, level)
                keys = context * SIZE + symbols
                if level > 1:  # only contexts that the level before has as continuations can be frequent enough
                    possible = shared.value.levels[-1][4]
                    at = np.minimum(np.searchsorted(possible, context), max(0, len(possible) - 1))
                    keys = keys[possible[at] == context] if len(possible) else keys[:0]
                held.append(keys)
            if sum(map(len, held)) >= FLUSH:
                yield from packed()
                held = []
        if sum(map(len, held)):
            yield from packed()

    def judge(keys: np.ndarray, counts: np.ndarray):
        """Of one bucket: frequent continuations of contexts, and which of these diverge."""
        context = keys // SIZE
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        group = np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1
        n = np.add.reduceat(counts, first)
        often = counts >= fewest
        group_, keys_, counts_ = group[often], keys[often], counts[often]
        extra = (counts_ - 1) / n[group_]
        rest = 1 - np.bincount(group_, extra, len(first))
        parent = shared.value.chance(context[often] % SIZE ** (level - 1), keys_ % SIZE, level - 1)
        own = extra + rest[group_] * parent
        gain = np.bincount(group_, own * np.log(own / parent), len(first)).astype(float)
        others = np.maximum(0, 1 - np.bincount(group_, own, len(first)))
        gain += others * np.log(np.maximum(rest, 1e-300))
        keep = (gain >= divergence) & (np.bincount(group_, minlength=len(first)) > 0)
        k = keep[group_]
        return context[first][keep], rest[keep], keys_[k], extra[k], keys_

    def merge(batches: Iterator[pa.RecordBatch]):
        bucket, parts = None, []

        def done():
            made = judge(*summed(*(np.concatenate(x) for x in zip(*parts))))
            return [[x.tobytes()] for x in made]

        for b in batches:
            for k, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                if k != bucket and parts:
                    yield done()
                    parts = []
                bucket = k
                parts.append((np.cumsum(unplane(keys)), unplane(counts)))
                if sum(len(x) for x, _ in parts) > 4 * FLUSH and len(parts) > 1:
                    parts = [summed(*(np.concatenate(x) for x in zip(*parts)))]
        if parts:
            yield done()

    counted = map_rows(docs, count, "bucket int, keys binary, counts binary")
    made = map_rows(
        counted.repartition("bucket").sortWithinPartitions("bucket"), merge,
        "contexts binary, rest binary, keys binary, extra binary, often binary",
    ).collect()  # at most 1 / least entries
    kinds = (np.int64, np.float64, np.int64, np.float64, np.int64)
    contexts, rest, keys, extra, often = (
        np.concatenate([np.frombuffer(r[i], kind) for r in made] or [np.zeros(0, kind)]) for i, kind in enumerate(kinds))
    a, b = np.argsort(contexts), np.argsort(keys)
    return contexts[a], rest[a], keys[b], extra[b], np.sort(often)


def learn(docs: DataFrame, depth: int = 2, least: float = LEAST, divergence: float = DIVERGENCE, symbols: int = SYMBOLS):
    """Tree of training documents (doc_id, text), vocabulary (word, c), and the numbers of tokens and types."""
    spark = docs.sparkSession
    vocabulary = materialize(count_words(docs), "vocabulary")
    total, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = vocabulary.filter("word is null").select("c").first()
    top = vocabulary.filter("word is not null").orderBy(F.desc("c"), "word").limit(min(symbols, SYMBOLS))
    top = top.select("word", "c").toPandas()  # at most ``symbols`` words
    base = np.zeros(SIZE)
    base[: len(top)] = (top.c.to_numpy() + 1) / (total + types + 1)
    base[END] = ((ends[0] if ends else 0) + 1) / (total + types + 1)
    base[RARE] = max(1 - base.sum(), 1e-300)
    tree = Tree(top.word.tolist(), base, [])
    for level in range(1, depth + 1):
        found = grow(docs, spark.sparkContext.broadcast(tree), level, total, least, divergence)
        tree = Tree(tree.words, base, [*(x[:4] for x in tree.levels), found])
    return Tree(tree.words, base, [x[:4] for x in tree.levels]), vocabulary, total, types


def score(docs: DataFrame, held_out=None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``held_out``: condition on doc_id of the documents that the model does not learn from (crc32 of the id as
    text modulo 7 is 2 by default; a null id trains).  Null text is empty and has the end alone.  Repeated
    doc_ids are scored row by row; other columns are ignored; an empty table gives no rows.
    All words and all continuations seen twice count, whatever the corpus (``suffix_rounds``).  With ``options`` of ``learn``
    the tree is one of that size, which every worker holds.
    """
    spark = docs.sparkSession
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)") if held_out is None else held_out
    given = texts(docs).withColumn("held_out", held_out)
    if not options:
        from . import suffix_rounds  # which builds on this module

        return suffix_rounds.score(given, DIVERGENCE)
    tree, vocabulary, total, types = learn(given.filter(~F.col("held_out")).select("doc_id", "text"), **options)
    shared = spark.sparkContext.broadcast(tree)
    depth = len(tree.levels)

    def rows(batches: Iterator[pa.RecordBatch]):
        t = shared.value
        for b in batches:
            for s, e in slices(b.column("text")):
                symbols, sizes, words = sequence(t, b.column("text").slice(s, e - s))
                of = np.repeat(np.arange(e - s), sizes)
                log = np.log10(t.chance(contexts_of(symbols, sizes, depth), symbols, depth))
                rare = symbols == RARE
                log[rare] -= np.log10(t.base[RARE])
                base = np.where(rare, 0.0, np.log10(t.base[symbols]))
                at = np.flatnonzero(rare[symbols != END])
                left, word = of[rare], words.take(pa.array(at)).to_numpy(zero_copy_only=False)
                cuts = np.searchsorted(left, np.arange(e - s + 1))
                known = np.bincount(of[~rare & (t.base[symbols] * (total + types + 1) > 1.5)], minlength=e - s)
                yield [
                    b.column("doc_id").slice(s, e - s), b.column("held_out").slice(s, e - s), sizes, known,
                    np.bincount(of, base, e - s), np.bincount(of, log, e - s),
                    [word[x:y] for x, y in zip(cuts[:-1], cuts[1:])],
                ]

    scored = materialize(map_rows(
        given, rows,
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, rare array<string>",
    ).withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("k"))
    p = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + types + 1)))
    rest = asked.join(vocabulary.filter("word is not null"), "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * p).alias("p"), F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("known"))
    zero = F.lit(0)
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("p", zero)).alias("base_score"),
        (F.col("log") + F.coalesce("p", zero)).alias("score"))
