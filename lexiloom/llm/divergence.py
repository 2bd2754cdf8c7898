"""Audit of how far the sources of a language diverge from each other in their terms.

Documents are cut into terms by an Arrow compute pipeline inside ``mapInArrow`` (ascii_lower, split_pattern_regex,
dictionary_encode, hash group_by), which leaves partial counts per language, source and term.  Merged, they are
columnar shards: a partition holds all sources of its terms, one after the other.  A shard gives every term's
divergence from its language, and for pairs of sources what the terms do that both have.  What a pair owes to the
terms that one of the two or none has depends on counts alone, so it comes from each source's histogram of counts.
All numbers are integers:

    p(t) = 1 + floor(10^9 (count + 1) / (N + V)),    f = floor((p - q)^2 / q)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import top_k
from .common import map_rows, materialize
from .suffix_tree import slices

NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Rows of partial counts or pairs that a task holds before it hands them on.
HELD = 400_000
#: Parts that the sources of one language are dealt into where they meet each other.
PARTS = 16


def terms_of(texts: pa.Array) -> pa.Table:
    """doc (index), term (dictionary), n: how often each text has each of its terms."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), NOT_TERM)
    found = pa.table({"doc": pc.list_parent_indices(lists), "term": lists.flatten()})
    found = found.filter(pc.not_equal(found["term"], ""))
    coded = found["term"].combine_chunks().dictionary_encode()
    counted = pa.table({"doc": found["doc"], "code": coded.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    return pa.table({
        "doc": counted["doc"], "n": counted["count_all"],
        "term": pa.DictionaryArray.from_arrays(counted["code"].combine_chunks(), coded.dictionary),
    })


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs, several rows of a term; a null term stands for the group itself."""
    keys = ["lang", "source", "term"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"})

    def rows(batches: Iterator[pa.RecordBatch]):
        held: list[pa.Table] = []

        def out():
            return [c.combine_chunks() for c in merged(held).select([*keys, "n", "docs"]).columns]

        for b in batches:
            lang, source = b.column("lang"), b.column("source")
            for s, e in slices(b.column("text")):
                found = terms_of(b.column("text").slice(s, e - s))
                of = found["doc"].combine_chunks()
                named = {"lang": lang.slice(s, e - s).take(of), "source": source.slice(s, e - s).take(of)}
                coded = pa.table({**named, "term": found["term"], "n": found["n"]}).group_by(keys).aggregate(
                    [("n", "sum"), ([], "count_all")])
                term = pc.cast(coded["term"].combine_chunks(), pa.string())
                held.append(pa.table({
                    "lang": coded["lang"], "source": coded["source"], "term": term, "n": coded["n_sum"], "docs": coded["count_all"]}))
            if b.num_rows:
                none = np.zeros(b.num_rows, np.int64)
                held.append(pa.table({"lang": lang, "source": source, "term": pa.nulls(b.num_rows, pa.string()), "n": none, "docs": none + 1}))
            if sum(t.num_rows for t in held) >= HELD:
                held = [merged(held)]
                if held[0].num_rows >= HELD // 2:
                    yield out()
                    held = []
        if held:
            yield out()

    return map_rows(docs, rows, "lang string, source string, term string, n long, docs long")


def scaled(count: Column | int, total: Column, types: Column) -> Column:
    """p of a count among ``total`` occurrences of ``types`` terms, as a long."""
    top = (F.lit(0) + count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + types).cast("decimal(20,0)")).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def scaled_all(count: np.ndarray, total: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The same for arrays, by long division in base 1000, so that nothing leaves 64 bits."""
    left, below, out = count + 1, total + types, np.zeros(len(count), np.int64)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, below)
        out = out * 1000 + digit
    return out + 1


def apart_all(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shard_divergences(rows: DataFrame) -> DataFrame:
    """part, lang, source, item, value from rows (lang, term, source, n, m, total, lang_total, types) of whole terms.

    ``term``: each term's f against its language where it is more frequent.  ``pair``: sums over the terms that
    both sources have, of f less what it is if one or both had none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole terms of about a batch."""
        rest: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            rest = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
            if rest.num_rows == 0:
                continue
            new = starts(rest)
            if new[-1]:
                yield rest.slice(0, new[-1])
                rest = rest.slice(new[-1])
        if rest is not None and rest.num_rows:
            yield rest

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in ("lang", "term"):
            col = t[c].combine_chunks()
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def pairs(t: pa.Table) -> Iterator[pa.Table]:
        """Pairs within each term, a bounded number at a time, summed by their two sources."""
        first = starts(t)
        size = np.diff(np.append(first, t.num_rows))
        of = np.repeat(np.arange(len(first)), size)
        group = pa.table({"lang": t["lang"], "source": t["source"]})
        lang, source = (group[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        code, lang_code = source.indices.to_numpy().astype(np.int64), lang.indices.to_numpy().astype(np.int64)
        n, total, types = (t[c].to_numpy() for c in ("n", "total", "types"))
        p, none = scaled_all(n, total, types), scaled_all(np.zeros_like(n), total, types)
        ends = np.cumsum(size[of])  # pairs up to each row
        at = 0
        while at < t.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
            reps = size[of[at:to]]
            a = np.repeat(np.arange(at, to), reps)
            b = np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps) + first[of[a]]
            a, b = a[a != b], b[a != b]
            value = apart_all(p[a], p[b]) - apart_all(p[a], none[b]) - apart_all(none[a], p[b]) + apart_all(none[a], none[b])
            sums = pa.table({"lang": lang_code[a], "source": code[a], "item": code[b], "value": value}).group_by(
                ["lang", "source", "item"]).aggregate([("value", "sum")])
            yield pa.table({
                "lang": lang.dictionary.take(sums["lang"]), "source": source.dictionary.take(sums["source"]),
                "item": source.dictionary.take(sums["item"]), "value": sums["value_sum"]})
            at = to

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.Table] = []

        def out():
            sums = pa.concat_tables(held).group_by(["lang", "source", "item"]).aggregate([("value", "sum")])
            return sums.rename_columns({"value_sum": "value"})

        def columns(part: str, t: pa.Table):
            return [pa.repeat(part, t.num_rows), *(t[c].combine_chunks() for c in ("lang", "source", "item", "value"))]

        for t in cut(batches):
            n, m, total, lang_total, types = (t[c].to_numpy() for c in ("n", "m", "total", "lang_total", "types"))
            p, q = scaled_all(n, total, types), scaled_all(m, lang_total, types)
            more = pa.array(p > q)
            yield columns("term", pa.table({
                "lang": t["lang"], "source": t["source"], "item": t["term"], "value": apart_all(p, q)}).filter(more))
            held.extend(pairs(t))
            if sum(x.num_rows for x in held) >= HELD:
                held = [out()]
                if held[0].num_rows >= HELD // 2:
                    yield columns("pair", held[0])
                    held = []
        if held:
            yield columns("pair", out())

    return map_rows(rows, run, "part string, lang string, source string, item string, value long")


def count_divergences(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value: parts of a pair's sum that follow from counts alone, several rows of a pair.

    With no shared term a pair's sum is that of V absent terms, and each term of one side replaces one of them.
    """
    deal = F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int")
    mine = totals.select("lang", "source", "total", "types", deal.alias("deal"))
    others = totals.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total")).withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    types, known = F.col("types"), F.col("types") > 0
    p0, q0 = scaled(0, F.col("total"), types), scaled(0, F.col("item_total"), types)
    absent = mine.join(others, ["lang", "deal"]).filter("source <> item").select(
        "lang", "source", "item", F.when(known, types * apart(p0, q0)).otherwise(0).alias("value"))
    histogram = rows.groupBy("lang", "source", "total", "types", "n").agg(F.count(F.lit(1)).alias("k"))
    p = scaled(F.col("n"), F.col("total"), types)
    met = histogram.withColumn("deal", deal).join(others, ["lang", "deal"]).filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("k") * (apart(p, q0) - apart(p0, q0))).alias("there"), F.sum(F.col("k") * (apart(q0, p) - apart(q0, p0))).alias("back"))
    return absent.unionByName(met.select("lang", "source", "item", F.col("there").alias("value"))).unionByName(
        met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))


def source_divergences(docs: DataFrame, fewest: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of sources (``pair``) and of terms (``term``).

    A language keeps the terms that ``fewest`` of its documents (rows) have.  ``pair`` rows compare a source with
    each other source of its language over all kept terms; ``term`` rows are the ``top`` terms of a source that
    are more frequent there than in its language.  Null lang, source and text are empty; texts without terms
    count as documents of their group; other columns are ignored, whatever their names.  Repeated rows count as
    often as they stand there.  Ranks go by value descending, then item by bytes.  An empty table gives no rows.
    """
    given = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # one shuffle by term serves the merge, the documents of a term and its count in the language
    whole = materialize(partial_counts(given), "counts").repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    merged = materialize(whole.withColumns({
        "m": F.sum("n").over(of_term), "held": F.sum("docs").over(of_term),
        "lead": F.row_number().over(of_term.orderBy("source")) == 1,
    }).filter((F.col("held") >= fewest) | F.col("term").isNull()).drop("docs", "held"), "terms")
    kept, groups = merged.filter("term is not null"), merged.filter("term is null").select("lang", "source")
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("types"))
    zero = F.lit(0).cast("long")
    totals = materialize(groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "types")]), "totals")
    rows = kept.drop("lead").join(totals, ["lang", "source"])
    shards = rows.select("lang", "term", "source", "n", "m", "total", "lang_total", "types").repartition(
        "lang", "term").sortWithinPartitions("lang", "term")
    found = materialize(shard_divergences(shards), "divergences")
    pairs = found.filter("part = 'pair'").drop("part").unionByName(count_divergences(rows, totals)).groupBy(
        "lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order, group = [F.desc("value"), F.col("item")], ["lang", "source", "part"]
    terms = top_k(found.filter("part = 'term'"), group, order, top)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return pairs.select(*group, "item", "value").unionByName(terms.select(*group, "item", "value")).withColumn("rank", rank)


#: The same in DuckDB's SQL.
SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
said AS (SELECT doc, lang, source, unnest(found) AS term FROM terms),
kept AS (SELECT lang, term, count(*) AS m FROM said GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
of_lang AS (SELECT lang, sum(m) AS total, count(*) AS types FROM kept GROUP BY lang),
counts AS (SELECT s.lang, s.source, s.term, count(*) AS n FROM said s SEMI JOIN kept k ON s.lang = k.lang AND s.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM terms),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
  GROUP BY ALL),
chance AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.types)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.m + 1)) // (l.total + l.types)::HUGEINT AS q
  FROM totals g JOIN kept k ON g.lang = k.lang JOIN of_lang l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN chance x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN chance y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
found AS (
  SELECT lang, source, part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM chance WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
