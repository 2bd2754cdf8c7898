"""Source divergence, Merkle manifest and exact search against SQL and plain Python."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import divergence, merkle, va_file

DOCS = "doc_id long, text string, lang string, source string, n_chars int, term string, value string, pos string, digest string"
WORDS = ["Alpha", "beta", "ÉTÉ", "straße", "日本", "x", "don't", "ALPHA9beta", "\x00gap\x7fgap", " wide"]


def documents(spark, n=140, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = None if i % 17 == 5 else "" if i % 17 == 6 else " 12 ! " if i % 17 == 7 else "\n".join(rng.choice(WORDS, rng.integers(1, 30)))
        source = None if i % 13 == 1 else "" if i % 13 == 2 else "hot" if rng.random() < 0.4 else f"s{rng.integers(5)}"
        rows.append((None if i % 50 == 9 else int(i // 2 if i % 7 == 0 else i), text, [None, "en", "de", ""][i % 4], source, None if i % 9 == 0 else i))
    rows += rows[20:24]  # repeated rows
    rows.append((5000, " ".join(WORDS) * 4000, "en", "long", 7))
    rows.append((5001, "lonely words only", "zz", "one", 3))
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = [tuple(r) for r in df.select(*names).collect()], cur.fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def frame(df):
    return pd.DataFrame(df.collect(), columns=df.columns).astype({"doc_id": "Int64", "n_chars": "Int64"})


@pytest.mark.parametrize("small", [False, True])
def test_divergences_equal_sql(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "HELD", 40)
    docs = documents(spark).repartition(3)
    got = same(divergence.source_divergences(docs), divergence.SQL, documents=frame(docs))
    assert {r[2] for r in got} == {"pair", "term"}
    assert all(r[2] == "pair" for r in got if r[0] == "zz") and not any(r[0] == "zz" for r in got)  # one source: no pairs, no kept terms


def test_divergences_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b", "en", "x"), (2, "A b", "en", "x"), (3, "a c", "en", "y"), (4, "b", "en", "z"), (5, "", "en", "w")],
                                 "doc_id long, text string, lang string, source string")
    got = {(r.source, r.part, r.item): r.value for r in divergence.source_divergences(docs, top=1).collect()}
    n = {"x": (3, 2), "y": (1, 0), "z": (0, 1), "w": (0, 0)}  # counts of a and b; c is in one document
    p = {s: [1 + 10**9 * (c + 1) // (sum(v) + 2) for c in v] for s, v in n.items()}
    q = [1 + 10**9 * (c + 1) // (7 + 2) for c in (4, 3)]
    for s in n:
        for o in n:
            if s != o:
                assert got[s, "pair", o] == sum((x - y) ** 2 // y for x, y in zip(p[s], p[o]))
    assert {k for k in got if k[1] == "term"} == {
        (s, "term", t) for s in n for i, t in enumerate("ab") if n[s][i] and p[s][i] > q[i]}


def test_long_division_is_exact():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 10**12, 2000)
    total = count + rng.integers(0, 10**14, 2000)
    types = rng.integers(1, 10**9, 2000)
    want = [1 + 10**9 * (int(c) + 1) // (int(n) + int(v)) for c, n, v in zip(count, total, types)]
    assert divergence.scaled_all(count, total, types).tolist() == want


def test_empty_tables(spark):
    docs = documents(spark).limit(0)
    assert divergence.source_divergences(docs).count() == 0
    assert merkle.manifest(docs).count() == 0
    assert va_file.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0


def plain_manifest(rows):
    """Rows of the manifest by a walk over lists."""
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))

    def path(hashes, i):
        """Digest on top, and (place, siblings) of each level above leaf i."""
        out = []
        while len(hashes) > 1:
            run = hashes[i // 3 * 3 : i // 3 * 3 + 3]
            out.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
            hashes, i = [H("".join(hashes[x : x + 3])) for x in range(0, len(hashes), 3)], i // 3
        return hashes[0], out

    leaves = {s: [leaf(r, r.text) for r in by[s]] for s in sources}
    tops = [path(leaves[s], 0)[0] for s in sources]
    out = []
    for no, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            root, high = path(tops, no)
            steps = path(leaves[s], i)[1] + high
            changed = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            folded = leaf(r, r.text.replace("\n", "") if changed else r.text)
            for place, beside in steps:
                folded = H("".join([*beside[:place], folded, *beside[place:]]))
            proof = H("".join(x for _, beside in steps for x in beside))
            out.append((r.doc_id, leaves[s][i], tops[no], root, proof, folded, folded == root))
    return out


def test_manifest_equals_plain_walk_and_sql(spark):
    docs = documents(spark)
    got = same(merkle.manifest(docs), merkle.SQL, documents=frame(docs))
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(docs.collect())))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n,sources", [(1, 1), (2, 1), (4, 1), (28, 1), (5, 5), (30, 2)])
def test_manifest_of_small_trees(spark, n, sources):
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a\n"), "id").alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("s"), F.col("id") % sources).alias("source"), F.lit(3).alias("n_chars"))
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(docs.collect())))


def test_tampering_is_a_parameter(spark):
    docs = documents(spark)
    same_text = merkle.manifest(docs, F.col("text"))
    assert same_text.filter("not verified").count() == 0
    changed = merkle.manifest(docs, F.when(F.col("doc_id") == 5000, F.lit("other")).otherwise(F.col("text")))
    assert [r.doc_id for r in changed.filter("not verified").collect()] == [5000]


def vectors(spark, n=700, dim=9, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype("f4") * 0.3
    x[40:80] = x[40]  # ties
    x[:, 3] = 0.5  # one value only
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows[20] = (20, [0.0] * dim)
    rows[21:27] = [(21, None), (22, [None] * dim), (23, [float("nan")] * dim), (24, [float("inf")] * dim), (25, []), (None, rows[0][1])]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")


@pytest.mark.parametrize("cells,block", [(64, 16384), (4, 50), (2, 100)])
def test_exact_search_equals_sql(spark, monkeypatch, cells, block):
    monkeypatch.setattr(va_file, "BLOCK", block)
    monkeypatch.setattr(va_file, "ASKED", 16)
    table = vectors(spark)
    found = va_file.search(table, "vec_id % 20 = 0", cells=cells)
    con = duckdb.connect()
    con.register("embeddings", table.select("vec_id", "embedding").toArrow())
    want = con.execute(va_file.SQL).fetchall()
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_few_candidates_other_lengths_and_large_numbers(spark):
    big = 2.0**40
    table = spark.createDataFrame(
        [(0, [big, 1.0]), (1, [big, -1.0]), (2, [-big, 5.0]), (20, [1.0, 1.0, 1.0]), (21, [0.5, 0.5, 0.5]), (40, [3.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in va_file.search(table, "vec_id % 20 = 0", k=5).orderBy("query_id", "rank").collect()]
    cut = (1 << 63) - 1
    assert got == [(0, 1, 1, cut), (0, 2, 2, -cut - 1), (20, 1, 21, 3 * 64 * 32)]
