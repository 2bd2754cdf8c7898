"""Null keys, repeated pages, limits and wide numbers: no row is lost and none is made up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_matching import VOCAB, WORDS, vocab_row, word_row

from lexiloom.operators import accuracy, chunking, collisions, learning, matching, metrics, tables

PAGES = "doc string, num long, text string"


def test_collision_groups_keep_rows_without_a_time(spark):
    rows = [vocab_row(i, "A", "x", "m") for i in range(1, 7)]
    v = spark.createDataFrame(rows, VOCAB).withColumn(
        "created_at", F.when(F.col("id") > 2, F.lit("2024-01-01").cast("timestamp")))
    got = collisions.collision_groups(v, spark.createDataFrame([], "vocab_id long")).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 6]


def test_pages_without_document_or_number(spark):
    pages = spark.createDataFrame([("a", 1, "Lesson 3\nx"), (None, 1, "Lesson 4\ny"), (None, 2, "z"), ("a", None, "w")], PAGES)
    filled = {(r.doc, r.num): r.lesson for r in chunking.fill_lesson(pages).collect()}
    assert filled == {("a", 1): 3, (None, 1): 4, (None, 2): 4, ("a", None): None}
    chunks = {(r.doc, r.page_start): r.text for r in chunking.pages_to_chunks(pages).collect()}
    assert chunks[(None, 1)].endswith("y\nz") and chunks[("a", 0)].endswith("w\nLesson 3\nx")


def test_pages_that_repeat_a_number(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y")], PAGES)
    (chunk,) = chunking.pages_to_chunks(pages).collect()
    assert (chunk.page_start, chunk.page_end) == (1, 1) and chunk.text.endswith("\n\nx\ny\ny")


def test_replay_without_learner_or_time(spark):
    day = dt.datetime(2024, 1, 2)
    ratings = spark.createDataFrame(
        [(None, 1, day, 1, 4), (7, 1, None, 2, 4), (7, 1, day, 3, 4)],
        "user_id long, vocab_id long, ts timestamp, event_id long, grade int")
    got = {r.user_id: r.repetitions for r in learning.replay_sm2(ratings).collect()}
    assert got == {None: 1, 7: 2}


def test_document_over_a_limit_fails_its_check(spark):
    pages = spark.createDataFrame([("big", i, "t") for i in range(4)] + [("ok", 1, "")], PAGES)
    specs = spark.createDataFrame(
        [("big", None, None, None, None, None, True), ("ok", None, None, None, None, None, True)],
        "doc string, required_text array<string>, minimum_pages int, minimum_characters int, expected_level string, "
        "expected_lesson int, expect_no_text boolean")
    got = {r.doc: (r.passed, r.reason) for r in accuracy.extraction_checks(pages, specs, max_pages=3).collect()}
    assert got == {"big": (False, "pages"), "ok": (True, None)}


def test_update_writes_null(spark):
    target = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "id int, x int, y int")
    changes = spark.createDataFrame([(1, None, None), (3, None, 9)], "id int, x int, y int")
    got = sorted(tuple(r) for r in tables.upsert(target, changes, ["id"], keep_old=["y"]).collect())
    assert got == [(1, None, 5), (2, 6, 6), (3, None, 9)]


@pytest.mark.parametrize("values", [
    [2**62, -(2**63), 2**63 - 1, 0, -1, 5], [3], [1, 2, 3, 4], list(range(-50, 300_000, 1_000)), [i << 33 for i in range(500)]])
def test_percentiles_of_wide_numbers(spark, values):
    got = metrics.rank_percentiles(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()
    order, n = sorted(values), len(values)
    assert (got.median, got.p95) == (order[n // 2], order[min(n - 1, n * 95 // 100)])


def test_percentiles_refuse_fractions(spark):
    with pytest.raises(TypeError):
        metrics.rank_percentiles(spark.createDataFrame([(1.5,)], "v double"), "v")


def test_alike_rows_are_not_paired(spark):
    """400 words and 400 rows of one block, all alike: a word meets lists of rows, and no pair comes twice."""
    words = spark.createDataFrame([word_row(i, "hot", "readingx", f"meaning of word {i}") for i in range(400)], WORDS)
    rows = spark.createDataFrame([vocab_row(i + 1, "hot", "reading", f"meaning of word {i}") for i in range(400)], VOCAB)
    best = matching.fuzzy_candidates(matching.incoming_keys(words), matching.stored_keys(rows))
    assert {r.meaning_key: r.fuzzy.similarity for r in best.collect()} == {
        r.meaning_key: 1.0 for r in matching.incoming_keys(words).collect()}
    pairs = matching.fuzzy_pairs(
        matching.incoming_keys(words).select("surface_key", "reading_key", "meaning_key").distinct(),
        matching.stored_keys(rows).select("surface_key", "reading_key", "meaning_key", F.col("id").alias("ex_id")))
    assert pairs.count() == pairs.distinct().count()
