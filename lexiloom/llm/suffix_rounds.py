"""Scores in a probabilistic suffix tree that holds all words and all repeated continuations of the training texts.

The model is that of ``suffix_tree`` without a bound: every word is a symbol, and a context's continuation is stored if it
was seen twice (seen once it counts nothing).  The tree is nowhere whole.  Texts are cut into pieces of some megabytes; a
piece asks for the counts of its distinct words, then, level by level, what the tree holds for its distinct pairs of a
context and a word.  What is asked about one word or context meets in one bucket, which counts, judges and answers
with what the score needs:

    round 0    word              its symbol and count c
    level k    context, word     m(s) and N(s) of the context, m(s) = 1 where it is not retained, and c(s, w)

A pair can only be seen twice if its context was, as a pair of the level before, and its word after the context's suffix.
So other contexts are not asked about, and other words of a context are asked about together.
Buckets hold about as many pairs each whatever the corpus, and what is shuffled grows with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, map_rows, materialize
from .suffix_tree import planes, slices, unplane, words_of

DEPTH = 2
START = OTHERS = 0  # before a text, as a context; words that a context has once at most, as a word
END, FIRST = 1, 2  # after a text, and from where words have their symbols
PIECE_BYTES = 12 << 20
BUCKET_TOKENS = 2_000_000

PIECES = "piece long, doc_id array<long>, held_out array<boolean>, sizes array<long>, words binary, places binary, dictionary binary, counts binary, tokens long, ends long"
ASKED = "bucket int, piece long, contexts binary, words binary, counts binary, parents binary, values binary"
ANSWERED = "round int, piece long, bucket int, first binary, second binary, third binary, total long, types long"


def packed(values: np.ndarray) -> bytes:
    return planes(values.view(np.int64) if values.dtype == np.float64 else values)


def numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return unplane(data).view(kind)


def packed_contexts(contexts: np.ndarray) -> bytes:
    """Contexts in order: differences of their upper halves, then the lower halves."""
    return packed(np.concatenate([np.diff(contexts >> 32, prepend=0), contexts & 0xFFFFFFFF]))


def contexts_in(data: bytes) -> np.ndarray:
    upper, lower = np.split(numbers(data), 2)
    return np.cumsum(upper) << 32 | lower


def packed_words(words: pa.Array) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress("\n".join(words.to_pylist()).encode())  # words hold no line feed


def unpacked_words(data: bytes) -> list[bytes]:
    import zstandard

    text = zstandard.ZstdDecompressor().decompress(data)
    return text.split(b"\n") if text else []


def pieces(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, held_out, text) in pieces.

    ``words`` are ranks by frequency in the piece, which take little room, ``places`` those of the ranks in the dictionary,
    which is in order of the words' hashes.
    """
    def made(held: list[pa.RecordBatch], piece: int) -> list:
        t = pa.Table.from_batches(held).combine_chunks()
        words, sizes = words_of(t.column("text").chunk(0))
        coded = words.dictionary_encode()
        train = np.repeat(~t.column("held_out").to_numpy().astype(bool), sizes)
        at = coded.indices.to_numpy()
        counts = np.bincount(at[train], minlength=len(coded.dictionary))
        order = np.argsort(hashes(coded.dictionary.cast(pa.binary()).to_pylist()), kind="stable")
        frequent = np.argsort(-np.bincount(at, minlength=len(order)), kind="stable")
        dictionary = coded.dictionary.take(pa.array(order, pa.int64()))
        ends = int((~t.column("held_out").to_numpy().astype(bool)).sum())
        return [[piece], [t.column("doc_id").to_pylist()], [t.column("held_out").to_pylist()], [sizes], [packed(inverse(frequent)[at])],
                [packed(inverse(order)[frequent])], [packed_words(dictionary)], [packed(counts[order])], [len(words) + len(sizes)], [ends]]

    def rows(batches: Iterator[pa.RecordBatch]):
        held, size, piece = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for s, e in slices(b.column("text")):
                held.append(b.slice(s, e - s))
                size += held[-1].column("text").nbytes
                if size >= PIECE_BYTES:
                    yield made(held, piece)
                    held, size, piece = [], 0, piece + 1
        if held:
            yield made(held, piece)

    return map_rows(docs.select("doc_id", "held_out", "text"), rows, PIECES)


def inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def dealt(context: np.ndarray, buckets: int) -> np.ndarray:
    mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % buckets


def by_bucket(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket's pairs, buckets in order."""
    order = np.argsort(where, kind="stable")
    found, first = np.unique(where[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


class Piece:
    """Tokens of a piece, their chances as far as they are answered, and the pairs to ask about next."""

    def __init__(self, row: dict, answers: pa.Table, buckets: int, totals: tuple[int, int, int]):
        self.row, self.buckets = row, buckets
        rounds = [[r for r in answers.to_pylist() if r["round"] == k] for k in range(DEPTH + 1)]
        rounds = [sorted(x, key=lambda r: r["bucket"]) for x in rounds]
        total, types, ends = totals
        ids, counts = (np.concatenate([numbers(r[c]) for r in rounds[0]] or [np.zeros(0, np.int64)]) for c in ("first", "second"))
        self.sizes = np.array(row["sizes"], np.int64) + 1
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.position = np.arange(len(self.of)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        inside = np.ones(len(self.of), bool)
        inside[np.cumsum(self.sizes) - 1] = False
        at = numbers(row["places"])[numbers(row["words"])]
        self.symbols, self.counts = np.full(len(self.of), END, np.int64), np.full(len(self.of), ends, np.int64)
        self.symbols[inside], self.counts[inside] = ids[at], counts[at]
        self.train = ~np.array(row["held_out"], bool)[self.of]
        self.base = (self.counts + 1) / (total + types + 1)
        self.chance = self.base.copy()
        # Contexts of a level: numbers in the order of ``values``, for level 1 symbols themselves.
        context, values, seen = np.where(self.position > 0, np.r_[START, self.symbols[:-1]], START), None, self.counts >= 2
        start = self.position == 0
        for level in range(1, DEPTH + 1):
            self.on = on = np.flatnonzero(np.where(start, level == 1, np.r_[False, seen[:-1]]))
            pairs, self.place = np.unique(context[on] << 32 | np.where(seen[on], self.symbols[on], OTHERS), return_inverse=True)
            self.contexts, self.words = pairs >> 32 if values is None else values[pairs >> 32], pairs & 0xFFFFFFFF
            self.where = dealt(self.contexts, buckets)
            if not rounds[level]:
                return
            order = np.argsort(self.where, kind="stable")
            rest, n, c = (np.empty(len(order)) for _ in range(3))
            for out, column, kind in ((rest, "first", float), (n, "second", np.int64), (c, "third", np.int64)):
                out[order] = np.concatenate([numbers(r[column], kind) for r in rounds[level]])
            often = (c >= 2) & (self.words != OTHERS)
            extra = np.where(often & (rest < 1), (c - 1) / np.maximum(n, 1), 0.0)
            self.chance[on] = extra[self.place] + rest[self.place] * self.chance[on]
            values, seen, pair = self.contexts << 32 | self.words, np.zeros(len(self.of), bool), np.zeros(len(self.of), np.int64)
            seen[on], pair[on] = often[self.place], self.place
            context = np.r_[START, pair[:-1]]

    def asked(self) -> list[list]:
        counts = np.bincount(self.place[self.train[self.on]], minlength=len(self.words))
        parents = np.ones(len(self.words))
        parents[self.place] = self.chance[self.on]
        parents[self.words == OTHERS] = 1.0  # not asked for
        out = [[] for _ in range(7)]
        for k, own in by_bucket(self.where):
            values, at = np.unique(parents[own], return_inverse=True)
            if 2 * len(values) > len(own):  # hardly any repeats
                values, at = parents[own], np.arange(len(own))
            for column, x in zip(out, (k, self.row["piece"], packed_contexts(self.contexts[own]), packed(self.words[own]),
                                       packed(counts[own]), packed(at), packed(values))):
                column.append(x)
        return out

    def scored(self) -> list:
        n = len(self.sizes)
        sums = lambda x: np.bincount(self.of, x, n)
        return [self.row["doc_id"], self.row["held_out"], self.sizes, sums(self.counts > 0).astype(np.int64),
                sums(np.log10(self.base)), sums(np.log10(self.chance))]


def judged(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, parents: np.ndarray, divergence: float):
    """For each given pair, of one bucket: m and N of its context, and how often the pair was seen."""
    each, at = np.unique(contexts, return_inverse=True)
    pairs, place = np.unique(at << 32 | words, return_inverse=True)
    group = pairs >> 32
    c = np.bincount(place, counts, len(pairs)).astype(np.int64)
    parent = np.empty(len(pairs))
    parent[place] = parents
    n = np.bincount(group, c, len(each)).astype(np.int64)
    often = (c >= 2) & (pairs & 0xFFFFFFFF != OTHERS)
    g, p = group[often], parent[often]
    extra = (c[often] - 1) / n[g]
    rest = 1 - np.bincount(g, extra, len(each))
    own = extra + rest[g] * p
    gain = np.bincount(g, own * np.log(own / p), len(each)).astype(float)
    others = np.maximum(0, 1 - np.bincount(g, own, len(each)))
    gain += others * np.log(np.maximum(rest, 1e-300))
    keep = (gain >= divergence) & (np.bincount(g, minlength=len(each)) > 0)
    return np.where(keep, rest, 1.0)[at], n[at], c[place]


def answer_words(cut: DataFrame, buckets: int) -> DataFrame:
    """Round 0: the symbol of every distinct word of a piece and how often training texts have it."""
    def ask(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pylist():
                words, counts = unpacked_words(row["dictionary"]), numbers(row["counts"])
                where = hashes(words) * buckets >> 32  # in order, as the dictionary is
                for k, own in by_bucket(where):
                    yield [[k], [row["piece"]], [None], [packed_words(pa.array(words[own[0]:own[-1] + 1], pa.string()))], [packed(counts[own])], [None], [None]]

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        words = [unpacked_words(r["words"]) for r in rows]
        coded = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
        at, bucket = coded.indices.to_numpy().astype(np.int64), rows[0]["bucket"]
        c = np.bincount(at, np.concatenate([numbers(r["counts"]) for r in rows]), len(coded.dictionary)).astype(np.int64)
        ids = inverse(np.argsort(-c, kind="stable")) * buckets + bucket + FIRST  # those of frequent words take little room
        out, first = [], 0
        for i, (r, x) in enumerate(zip(rows, words)):
            own = at[first:first + len(x)]
            first += len(x)
            out.append([0, r["piece"], bucket, packed(ids[own]), packed(c[own]), None,
                        0 if i else int(c.sum()), 0 if i else int((c > 0).sum())])
        return as_table(out, schema)

    schema = arrow_schema(ANSWERED)
    return map_rows(cut.select("piece", "dictionary", "counts"), ask, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)


def as_table(rows: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def answer_level(asked: DataFrame, level: int, divergence: float) -> DataFrame:
    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        contexts = [contexts_in(r["contexts"]) for r in rows]
        words, counts = (np.concatenate([numbers(r[c]) for r in rows]) for c in ("words", "counts"))
        found = judged(np.concatenate(contexts), words, counts, np.concatenate([numbers(r["values"], float)[numbers(r["parents"])] for r in rows]), divergence)
        cuts = np.cumsum([len(x) for x in contexts])[:-1]
        return as_table([
            [level, r["piece"], r["bucket"], packed(rest), packed(n), packed(c), 0, 0]
            for r, rest, n, c in zip(rows, *(np.split(x, cuts) for x in found))], schema)

    schema = arrow_schema(ANSWERED)
    return asked.groupBy("bucket").applyInArrow(answer, ANSWERED)


def score(given: DataFrame, divergence: float) -> DataFrame:
    """``suffix_tree.score`` of (doc_id, held_out, text)."""
    cut = materialize(pieces(given), "pieces")
    tokens, ends = cut.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    buckets = int(np.clip(tokens // BUCKET_TOKENS, 1, 1 << 16))
    answered = materialize(answer_words(cut, buckets), "answers")
    total, types = answered.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    total, types = total + ends, types + (ends > 0)
    texts = cut.drop("dictionary", "counts", "tokens", "ends")

    def piece(left: pa.Table, right: pa.Table) -> Piece:
        return Piece(left.to_pylist()[0], right, buckets, (total, types, ends))

    def with_answers(rows, schema: str) -> DataFrame:
        arrow = arrow_schema(schema)

        def made(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows(piece(left, right)), arrow)], schema=arrow)

        return texts.groupBy("piece").cogroup(answered.drop("total", "types").groupBy("piece")).applyInArrow(made, schema)

    for level in range(1, DEPTH + 1):
        asked = with_answers(lambda p: p.asked(), ASKED)
        answered = answered.unionByName(materialize(answer_level(asked, level, divergence), "answers"))
    out = with_answers(lambda p: p.scored(), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
