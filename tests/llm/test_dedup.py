"""Near-duplicates, line alignment, nearest neighbours and embedding links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import ann, components, embed_dedup, line_dedup, near_copies, simhash


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(ids, edges):
    low = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(500) for _ in range(400)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 8, 60, 400))):
            words[rng.randrange(400)] = "x%d" % rng.randrange(999)
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "a b"), (300, docs[0][1]), (300, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "rep": F.lit(1), "component_id": F.lit(2)})
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(docs)
    prints = {d: plain_print(t) for d, t in docs if d is not None}
    ids = sorted(prints)
    edges = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = classes(ids, edges)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert int(r.fingerprint, 16) == (prints[r.doc_id] if r.doc_id is not None else prints[0])
    kept = sorted(r.doc_id for r in simhash.keep_first(df).collect() if r.doc_id is not None)
    assert kept == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_connect_their_texts(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "one two three four five"), (9, "one two three four five")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (9, 1)}


def test_segments_leave_no_pair_out(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1, 1)], "fp long, rep long"), 5)


@pytest.mark.parametrize("few,block,stars", [(16, 256, 2), (2, 4, 0)])
def test_near_copies_match_brute_force(spark, few, block, stars, monkeypatch):
    for name, value in (("FEW", few), ("BLOCK", block), ("STARS", stars)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(8)
    docs = []
    for g in range(6):
        base = ["g%dw%d" % (g, rng.randrange(500)) for _ in range(300)]
        for i in range(20):
            words = list(base)
            for _ in range(rng.choice((0, 1, 3, 5, 7, 12, 40))):
                words[rng.randrange(300)] = "x%d" % rng.randrange(9999)
            docs.append((100 * g + i, " ".join(words)))
    docs += [(900, None), (901, " "), (902, "One two"), (903, "one  TWO"), (904, "One three"), (905, docs[0][1]), (905, docs[30][1]), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "id": F.lit(1), "x": F.lit(2)})
    sets = []
    for d, t in docs:
        w = (t or "").lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    sets = [x for x in sets if x[0] is not None]
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x == y or 5 * len(x & y) >= 4 * len(x | y)]
    got = near_copies.keep_first(df)
    assert got.columns == df.columns and got.filter("doc_id is null").count() == 1
    assert sorted(r.doc_id for r in got.filter("doc_id is not null").collect()) == sorted(set(classes(sorted({d for d, _ in sets}), edges).values()))
    assert near_copies.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(90, 80), (80, 90)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: c for n, c in classes(sorted(nodes), [e for e in edges if e[0] != e[1]]).items()}


PASSAGE = "\n".join(f"line {i} " + " ".join(f"p{i}w{j}" for j in range(12)) for i in range(5))


def test_lines_of_an_earlier_document_go(spark):
    own = lambda n: "\n".join(f"own {n} line {i} of its document" for i in range(4))
    docs = [(1, f"{own(1)}\n{PASSAGE}\nend one"), (2, f"{own(2)}\n\n{PASSAGE}\n{own(22)}"), (3, f"short header\n{own(3)}"), (4, f"short header\n{own(4)}"),
            (5, PASSAGE), (5, PASSAGE), (None, "null id"), (6, None), (7, ""), (8, "\n".join(["again and again we say it"] * 9)), (9, "\n".join(["again and again we say it"] * 9))]
    docs += [(100 + i, f"{own(100 + i)}\n{PASSAGE}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc": F.lit("clash"), "th": F.lit(0), "gone": F.lit(1)})
    rows = line_dedup.drop_repeats(df).collect()
    assert len(rows) == len(docs) and rows[0].doc == "clash"
    got = {r.doc_id: r for r in rows}
    assert got[1].text == docs[0][1] and got[1].line_dedup_gone == 0
    assert got[2].text == f"{own(2)}\n\n{own(22)}" and got[2].line_dedup_gone == 5
    assert got[3].text == docs[2][1] and got[4].text == docs[3][1]
    assert got[5].text == "" and got[6].text is None and got[7].text == ""
    assert got[8].text == docs[9][1] and got[9].text == ""
    assert all(got[100 + i].text == own(100 + i) for i in range(20))
    assert line_dedup.drop_repeats(df.limit(0)).count() == 0


def test_alignment_is_in_order():
    assert line_dedup.longest_chain([0, 1, 2, 3, 4], [5, 1, 2, 9, 3]) == [1, 2, 4]
    assert line_dedup.align([(0, 0, True), (1, 5, False), (2, 2, True), (3, 1, False)]) == [0, 2]
    assert sorted(line_dedup.align([(0, 3, False), (1, 4, True), (2, 5, False)])) == [0, 1, 2]


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 24))
    x[n // 2 :] = x[rng.integers(0, 6, n - n // 2)] + 0.05 * rng.standard_normal((n - n // 2, 24))
    return np.ascontiguousarray(x)


ODD = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] + [1.0] * 23), (9005, [float("inf")] * 24), (9006, [None] + [1.0] * 23), (None, [1.0] * 24)]
VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("n", [600, 12])
def test_nearest_neighbours(spark, n):
    x = clusters(n, 1)
    x[3] = x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD + [(5, x[5].tolist())], VECTORS).withColumns(
        {"v": F.lit("clash"), "list": F.lit(0), "score": F.lit(1)})
    got = {}
    for r in ann.search(df, "vec_id % 20 = 0", block_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, n, 20))
    right = total = 0
    for q, rows in got.items():
        rows.sort()
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:20]
        assert [r[0] for r in rows] == list(range(1, len(order) + 1))
        assert np.allclose([r[2] for r in rows], [s[r[1]] for r in rows], rtol=1e-12)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        right, total = right + len({r[1] for r in rows} & set(order)), total + len(order)
    assert right / total >= 0.9
    assert ann.search(spark.createDataFrame(ODD, VECTORS), "vec_id % 20 = 0").count() == 0


def test_embedding_links(spark):
    x = clusters(400, 2)
    x[7] = x[6] * 3
    x[9] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD + [(5, x[5].tolist())], VECTORS).withColumns(
        {"id": F.lit("clash"), "n": F.lit(0), "component": F.lit(1)})
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = classes(range(400), list(zip(*map(list, np.nonzero(near)))))
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, block=37).collect()}
    assert sorted(got) == sorted([*range(400), *(i for i, _ in ODD if i is not None)])
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), want[i], want[i] == i), i
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in ODD if i is not None)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_the_row_that_stays_of_a_repeated_id_is_defined(spark):
    """Whatever the partitioning, and for equal texts by the other columns."""
    from lexiloom.llm.common import one_row_each

    rows = [(1, t, "en", n) for t in ("b", "a", "c", None) for n in range(3)] + [(2, "same", lang, 0) for lang in ("x", "a", "m")] + [(3, None, None, None)]
    rng = random.Random(2)
    seen = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string, lang string, n_chars int").repartition(parts)
        for keep in (one_row_each, near_copies.keep_first, simhash.keep_first):
            out = sorted(map(tuple, keep(df).collect()), key=repr)
            assert len({r[0] for r in out}) == len(out)
            if keep is one_row_each:
                seen.add(tuple(out))
            else:
                assert set(out) <= set(next(iter(seen)))
    assert len(seen) == 1 and (2, "same", "a", 0) in next(iter(seen))


def test_lone_pairs_beside_a_hot_group_are_linked(spark, monkeypatch):
    """A third of the vectors are near each other; the audit speaks of the others, and rightly so."""
    rng = np.random.default_rng(0)
    n, dim, hot, pairs = 3000, 64, 1000, 150
    x = rng.standard_normal((n, dim))
    x[:hot] = x[0] / np.linalg.norm(x[0]) + rng.standard_normal((hot, dim)) * 0.03
    x /= np.linalg.norm(x, axis=1)[:, None]
    for a in range(hot, hot + 2 * pairs, 2):
        cos, r = rng.uniform(0.905, 0.96), rng.standard_normal(dim)
        r -= r @ x[a] * x[a]
        x[a + 1] = cos * x[a] + np.sqrt(1 - cos * cos) * r / np.linalg.norm(r)
    told = []
    plain_audit = embed_dedup.audit
    monkeypatch.setattr(embed_dedup, "audit", lambda *a: told.append(plain_audit(*a)) or told[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embed_dedup.near_vectors(df, audited=n).collect()}
    true = (x @ x.T >= 0.9).sum(1) - 1
    got = np.array([out[i].n_links for i in range(n)])
    assert (got[:hot] == true[:hot]).all() and (got <= true).all()
    share = np.mean([g / t for g, t in zip(got[hot:], true[hot:]) if t])
    assert share >= 0.95 and abs(told[-1] - share) <= 0.02


def test_tables_grow_with_the_hyperplanes():
    counts = [embed_dedup.tables_for(n, 64, 0.9, 0.03) for n in (64, 10_000, 1_000_000, 100_000_000)]
    assert [b for b, _ in counts] == [1, 7, 14, 21] and sorted(t for _, t in counts) == [t for _, t in counts]
