import json
import random

import plain
import pytest
from pyspark.sql import functions as F
from test_matching import REVIEWS, VOCAB

from lexiloom.functions.text import LATIN
from lexiloom.operators import collisions, pages, reviews
from lexiloom.operators.words import Scripts

ASCII = Scripts(LATIN, LATIN)
PROGRESS = "vocab_id long, status string, repetitions int"


def vocab(spark, *rows):
    """Rows of (id, key, kanji, kana, romaji, meaning, example, created)."""
    full = [(i, k, s, r, ro, m, "N5", None, ex, None, None, None, f"2024-01-{day:02d} 00:00:00")
            for i, k, s, r, ro, m, ex, day in rows]
    return spark.createDataFrame(full, VOCAB.replace("timestamp", "string")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def review_rows(spark, *rows):
    full = [(k, j, c, 0.9, "[]", None, "f", s, "2024-01-01 00:00:00") for k, j, c, s in rows]
    return spark.createDataFrame(full, REVIEWS.replace("timestamp", "string")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def test_collision_ranking(spark):
    v = vocab(spark, (1, None, "A", "x", None, "m", None, 3), (2, None, "A", "x", None, "m", "ex", 5),
              (3, None, "A", "x", None, "m", None, 2), (4, None, "B", "y", None, "m", None, 1), (5, None, " A", "X".lower(), None, "m", "e", 4))
    p = spark.createDataFrame([(3, "learning", 0)], PROGRESS)
    got = [(r.id, r.score, r["rank"], r.group_size) for r in collisions.collision_groups(v, p).orderBy("rank").collect()]
    assert got == [(3, 2, 1, 4), (5, 2, 2, 4), (2, 2, 3, 4), (1, 1, 4, 4)]
    targets = spark.createDataFrame([("surface:A\0reading:x", 3)], "identity_key string, target_id long")
    assert {r.id for r in collisions.rows_to_remove(collisions.collision_groups(v, p), targets).collect()} == {1, 2, 5}


def test_merge_pairs(spark):
    key = "surface:A\0reading:x"
    v = vocab(spark, (1, None, "A", "X x".lower().replace(" ", ""), None, "", None, 1), (2, None, "A", "xx", "r2", "m2", None, 2),
              (3, None, "A", "xx", "r3", "m3", "e3", 3), (4, None, "B", "y", None, "m", None, 1),
              (5, "surface:C\0reading:z", "C", "z", None, "m", None, 1), (6, None, "C", "z", "r6", "m6", None, 1))
    p = spark.createDataFrame([(2, "learning", 0), (3, "mastered", 3), (5, "learning", 1), (6, "learning", 2)], PROGRESS)
    r = review_rows(spark, ("k2", "{}", 2, "pending"), ("k4", "{}", 4, "pending"))
    pairs = spark.createDataFrame(
        [(0, 1, 1), (1, 9, 1), (2, 4, 1), (3, 2, 1), (4, 3, 1), (5, 2, 3), (6, 1, 3), (7, 5, 6), (8, 6, 5), (9, None, 1), (10, 4, 2)],
        "position long, source_id long, target_id long")
    out = collisions.merge_collisions(pairs, v, p, r)
    assert {x.position: x.outcome for x in out.outcomes.collect()} == {
        0: "invalid_rows", 1: "row_not_found", 2: "keys_differ", 3: "ok", 4: "ok", 5: "row_not_found", 6: "row_not_found",
        7: "key_occupied", 8: "ok", 9: "invalid_rows", 10: "row_not_found"}
    rows = {x.id: x for x in out.vocabulary.collect()}
    assert set(rows) == {1, 4, 5}
    assert (rows[1].romaji, rows[1].burmese_meaning, rows[1].example_sentence_jp) == ("r2", "m2", "e3")
    assert rows[1].canonical_key == "surface:A\0reading:xx" and key != rows[1].canonical_key
    assert {(x.vocab_id, x.repetitions) for x in out.progress.collect()} == {(1, 0), (5, 1)}
    assert {x.review_key: x.candidate_id for x in out.reviews.collect()} == {"k2": 1, "k4": 4}


def test_merge_batch_is_all_or_nothing(spark):
    v = vocab(spark, *[(i, None, "A" if i < 4 else "B", "x", None, "m", None, i) for i in range(1, 7)])
    p, r = spark.createDataFrame([], PROGRESS), review_rows(spark, ("k", "{}", 1, "pending"))
    schema = "group_no int, target_id long, source_ids array<long>"
    good = spark.createDataFrame([(0, 1, [1, 2, 3]), (1, 4, [5, 6])], schema)
    out = collisions.merge_collision_batch(good, v, p, r)
    assert {x.id for x in out.vocabulary.collect()} == {1, 4}
    bad = spark.createDataFrame([(0, 1, [2, 3]), (1, 4, [3])], schema)
    out = collisions.merge_collision_batch(bad, v, p, r)
    assert out.vocabulary.count() == 6 and {x.outcome for x in out.outcomes.collect()} == {"rolled_back", "row_not_found"}
    over = collisions.merge_collision_batch(good, v, p, r, max_rows=3)
    assert over.vocabulary.count() == 6 and {x.outcome for x in over.outcomes.collect()} == {"request_over_limit"}


def test_backfill(spark):
    v = vocab(spark, (1, None, "A", "x", None, "m", None, 1), (2, "old", None, "y", None, "m", None, 1))
    filled, found = collisions.backfill_keys(v)
    assert {r.id: r.canonical_key for r in filled.collect()} == {1: "surface:A\0reading:x", 2: "reading:y"} and found.count() == 0
    twice = v.unionByName(vocab(spark, (3, None, "A", "x", None, "m", None, 1)))
    filled, found = collisions.backfill_keys(twice)
    assert {r.id: r.canonical_key for r in filled.collect()} == {1: None, 2: "old", 3: None} and found.count() == 2


def word_json(**kw):
    return json.dumps({"kanji": "A", "kana": "x", "burmese_meaning": "m", **kw})


def test_review_decisions(spark):
    v = vocab(spark, (1, "surface:A\0reading:y", "A", "y", None, "m", None, 1), (2, "surface:A\0reading:q", "A", "q", None, "m", None, 2))
    r = review_rows(
        spark, ("a", word_json(romaji="r"), 1, "pending"), ("b", word_json(), 1, "pending"), ("c", "{bad", 1, "pending"), ("d", word_json(), 9, "pending"),
        ("e", word_json(), 1, "accepted"), ("f", word_json(kana="q"), 1, "pending"), ("g", word_json(), 2, "pending"))
    asked = [(0, "a", "accept"), (1, "a", "reject"), (2, "b", "reject"), (3, "c", "accept"), (4, "d", "accept"), (5, "e", "accept"),
             (6, "f", "accept"), (7, "g", "accept"), (8, "zz", "accept"), (9, "b", "maybe")]
    d = spark.createDataFrame(asked, "position long, review_key string, action string")
    rev, voc, out = reviews.apply_review_decisions(r, d, v, ASCII)
    assert {x.position: x.outcome for x in out.collect()} == {
        0: "accepted", 1: "already_decided", 2: "rejected", 3: "payload_invalid", 4: "candidate_missing", 5: "already_decided",
        6: "duplicate_identity", 7: "duplicate_identity", 8: "not_found", 9: "bad_request"}
    assert {x.review_key: x.status for x in rev.collect()} == {
        "a": "accepted", "b": "rejected", "c": "pending", "d": "pending", "e": "accepted", "f": "pending", "g": "pending"}
    row = {x.id: x for x in voc.collect()}[1]
    assert (row.canonical_key, row.kana, row.romaji) == ("surface:A\0reading:x", "x", "r")
    queue = reviews.review_queue(r, v, 3).collect()
    assert len(queue) == 3 and {q.review_key for q in queue} == {"a", "b", "c"}


def one_by_one(stored, rows, asked):
    """Outcomes and keys after decisions made in turn; ``rows``: review -> (candidate, key, status, fails)."""
    key_of, status, out = dict(stored), {r: x[2] for r, x in rows.items()}, {}
    for pos, review, action in sorted(asked):
        row, key, _, fails = rows[review]
        if status[review] != "pending":
            out[pos] = "already_decided"
        elif action == "reject":
            status[review] = out[pos] = "rejected"
        elif row not in key_of:
            out[pos] = "candidate_missing"
        elif fails:
            out[pos] = "payload_invalid"
        elif any(k == key for r, k in key_of.items() if r != row):
            out[pos] = "duplicate_identity"
        else:
            key_of[row] = key
            status[review] = out[pos] = "accepted"
    return out, key_of


@pytest.mark.parametrize("rows,keys,reviews_n,hot", [(5, 4, 40, 0.0), (40, 30, 120, 0.0), (30, 25, 150, 0.5)])
def test_review_decisions_free_keys_like_one_by_one(spark, rows, keys, reviews_n, hot):
    rng = random.Random(rows)
    name = lambda k: f"surface:A\0reading:x{k}"
    stored = {i: (name(i) if i < keys // 2 else None) for i in range(rows)}
    pick = lambda n: 0 if rng.random() < hot else rng.randrange(n)
    revs = {f"v{i}": (pick(rows + 1), name(pick(keys)), rng.choice(["pending"] * 9 + ["accepted"]), rng.random() < 0.05) for i in range(reviews_n)}
    asked = [(p, f"v{pick(reviews_n)}" if rng.random() < 0.3 else f"v{rng.randrange(reviews_n)}", rng.choice(["accept"] * 6 + ["reject"])) for p in range(reviews_n * 3)]
    r = review_rows(spark, *[(k, "{bad" if bad else word_json(kana=key.split("reading:")[1]), row, status) for k, (row, key, status, bad) in revs.items()])
    d = spark.createDataFrame(rng.sample(asked, len(asked)), "position long, review_key string, action string")
    v = vocab(spark, *[(i, k, "A", "y", None, "m", None, 1) for i, k in stored.items()])
    _, voc, out = reviews.apply_review_decisions(r, d, v, ASCII)
    want, key_of = one_by_one(stored, revs, asked)
    assert {x.position: x.outcome for x in out.collect()} == want
    assert {x.id: x.canonical_key for x in voc.collect()} == key_of
    assert set(want.values()) >= {"accepted", "duplicate_identity", "already_decided"}


@pytest.mark.parametrize("run_size", [1, 3, 16384])
def test_corrections_match_plain(spark, run_size):
    rng = random.Random(run_size)
    start = {1: 0, 2: 4, 3: 0}
    rows, want = [], {}
    for page, n in ((1, 60), (2, 25), (3, 4)):
        level, chain = start[page], []
        for pos in range(n):
            base = max(0, level + rng.choice([0, 0, 0, -1, 1, -3]))
            level += base == level
            chain.append((pos, base))
        rows += [(page, pos, base, f"text {pos}") for pos, base in chain]
        want.update({(page, p): (o, r) for p, o, r in plain.corrections(start[page], chain)})
    rows += [(1, 100, 0, "  "), (1, 101, -1, "x"), (8, 0, 0, "x")]
    df = spark.createDataFrame(rows, "page_id long, position long, base_revision long, corrected_text string").repartition(3)
    p = spark.createDataFrame([(k, v, "raw", "queued") for k, v in start.items()], "page_id long, revision long, raw_text string, status string")
    out = pages.apply_corrections(p, df, run_size)
    got = {(r.page_id, r.position): (r.outcome, r.revision) for r in out.collect()}
    want.update({(1, 100): ("invalid", None), (1, 101): ("invalid", None), (8, 0): ("page_not_found", None)})
    assert got == want
    accepted = {(r.page_id, r.revision): (r.corrected_text, r.original_text) for r in out.filter("outcome = 'accepted'").collect()}
    for (page, revision), (_, before) in accepted.items():
        assert before == (accepted[(page, revision - 1)][0] if (page, revision - 1) in accepted else "raw")
    now = {r.page_id: (r.revision, r.raw_text) for r in pages.current_text(p, out).collect()}
    assert all(now[page] == (rev, accepted[(page, rev)][0]) for page, rev in ((k, max(r for q, r in accepted if q == k)) for k in start if any(q == k for q, _ in accepted)))


PAGES = "page_id long, batch_id string, page_number int, raw_text string, status string, revision long, error_category string, error_message string"
CANDS = ("candidate_id string, batch_id string, page_id long, incoming_json string, canonical_key string, decision_kind string, "
         "status string, score double, reasons_json string, vocabulary_id long, created_at timestamp")


def candidates(spark, *rows):
    full = [(c, "b", p, j, None, k, s, None, None, None, f"2024-01-01 00:00:{n:02d}") for n, (c, p, j, k, s) in enumerate(rows)]
    return spark.createDataFrame(full, CANDS.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_reprocess_and_preview(spark):
    v = vocab(spark, (1, "surface:A\0reading:x", "A", "x", None, "m", None, 1))
    p = spark.createDataFrame([(1, "b", 1, "A x m\nB y n;C z o", "corrected", 1, None, None), (2, "b", 2, "12 34", "corrected", 1, None, None)], PAGES)
    c = candidates(spark, ("old", 1, word_json(), "new", "pending"), ("kept", 1, word_json(), "new", "approved"), ("other", 3, word_json(), "new", "pending"))
    p2, c2 = pages.reprocess(p, c, v, scripts=ASCII)
    assert {r.page_id: (r.status, r.error_category) for r in p2.collect()} == {1: ("needs_review", None), 2: ("failed", "no_valid_candidates")}
    got = {r.candidate_id: (r.decision_kind, r.vocabulary_id, r.reasons_json) for r in c2.filter("status = 'pending' and page_id = 1").collect()}
    exact, new = '["canonical key already exists"]', '["no exact canonical match"]'
    assert got == {"1-0": ("exact", 1, exact), "1-1": ("new", None, new), "1-2": ("new", None, new)}
    assert {r.candidate_id for r in c2.collect()} == {"1-0", "1-1", "1-2", "kept", "other"}
    shown = {r.candidate_id: (r.decision, r.collision_risk) for r in pages.preview(c2, v, ASCII).collect()}
    assert shown == {"1-0": ("exact", "low"), "1-1": ("new", "unknown"), "1-2": ("new", "unknown"), "other": ("exact", "low")}


def test_approve_and_reject(spark):
    v = vocab(spark, (1, "surface:A\0reading:x", "A", "x", None, "m", None, 1))
    p = spark.createDataFrame([(1, "b", 1, "t", "needs_review", 1, None, None), (2, "b", 2, "t", "needs_review", 1, None, None)], PAGES)
    c = candidates(
        spark, ("c0", 1, word_json(), "exact", "pending"), ("c1", 1, "{}", "new", "pending"), ("c2", 1, word_json(kana="y"), "new", "pending"),
        ("c3", 1, word_json(kana="y"), "new", "pending"), ("c4", 1, word_json(kana="y"), "review", "pending"),
        ("c5", 2, word_json(kana="w"), "new", "pending"), ("c6", 1, word_json(), "new", "approved"))
    new_id = F.lit(100) + F.substring("candidate_id", 2, 9).cast("long")
    p2, c2, v2, r2 = pages.approve(p.filter("page_id = 1"), c, v, review_rows(spark, ("ingestion:c4", "{}", None, "rejected")), new_id, scripts=ASCII)
    assert [(r.page_id, r.status) for r in p2.collect()] == [(1, "needs_review")]
    got = {r.candidate_id: (r.status, r.decision_kind, r.vocabulary_id) for r in c2.collect()}
    assert got == {
        "c0": ("approved", "exact", 1), "c1": ("rejected", "invalid", None), "c2": ("approved", "new", 102), "c3": ("approved", "new", 102),
        "c4": ("review", "review", 102), "c5": ("pending", "new", None), "c6": ("approved", "new", None)}
    assert {(r.id, r.pdf_source) for r in v2.collect()} == {(1, None), (102, "ingestion-page:1")}
    row = r2.collect()[0]
    assert (row.status, row.candidate_id, row.score) == ("pending", 102, 0.9)
    req = spark.createDataFrame([(2, 1, "r" * 600), (2, 0, "z")], "page_id long, position long, reason string")
    p3, c3 = pages.reject(p, c, req)
    assert {r.page_id: (r.status, len(r.error_message or "")) for r in p3.collect()} == {1: ("needs_review", 0), 2: ("rejected", 500)}
    assert {r.candidate_id for r in c3.filter("status = 'rejected'").collect()} == {"c5"}


def test_listing(spark):
    p = spark.createDataFrame([(1, "b", 1, "t", "needs_review", 1, None, None), (2, "b", 2, "t", "approved", 1, None, None)], PAGES)
    c = candidates(spark, *[(f"c{i}", 1, "{}", "new", "pending") for i in range(5)])
    k = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "page_id long, revision long, corrected_text string")
    rows = {r.page_id: r for r in pages.page_candidates(p, c, k, 3).collect()}
    assert [x.candidate_id for x in rows[1].candidates] == ["c0", "c1", "c2"] and rows[1].corrections == 2 and rows[2].corrections == 0
    b = spark.createDataFrame([("b", "f.pdf", "completed")], "batch_id string, source_name string, status string")
    detail = pages.page_detail(p, b, c, k).filter("page_id = 1").orderBy("item", "sort_key").collect()
    assert [r.item_id for r in detail] == ["c0", "c1", "c2", "c3", "c4", "2", "1"]
    assert pages.attention_pages(p).count() == 1
