import random
from datetime import datetime, timedelta

import plain
import pytest
from pyspark.sql import functions as F
from test_matching import POOL, REVIEWS, VOCAB, WORDS, as_dicts, random_rows, word_row

from lexiloom.operators import learning, pages
from lexiloom.streaming import jobs
from lexiloom.streaming.snapshots import Snapshots


@pytest.fixture
def replay(spark, tmp_path):
    """Feed rows as one file per micro-batch and return everything the stream emits."""
    jobs.use_rocksdb(spark)

    def run(batches, schema, build, mode):
        src = tmp_path / "src"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        out = []
        q = (build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend((n, r) for r in df.collect()))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
        return out

    return run


def test_sm2_stream_equals_batch(spark, replay):
    rng = random.Random(2)
    schema = "user_id long, vocab_id long, ts timestamp, event_id long, grade int"
    rows = [(rng.randint(0, 3), rng.randint(0, 2), datetime(2024, 1, 1) + timedelta(hours=i), i, rng.choice([0, 2, 3, 4, 5])) for i in range(90)]
    emitted = replay([rows[:40], rows[40:70], rows[70:]], schema, jobs.stream_sm2, "update")
    last = {}
    for n, r in sorted(emitted, key=lambda e: e[0]):
        last[(r.user_id, r.vocab_id)] = (r.ease_factor, r.interval, r.repetitions, r.status, r.ratings, r.next_review_date)
    batch = learning.replay_sm2(spark.createDataFrame(rows, schema)).collect()
    assert last == {(r.user_id, r.vocab_id): (r.ease_factor, r.interval, r.repetitions, r.status, r.ratings, r.next_review_date) for r in batch}


RATINGS = "user_id long, vocab_id long, ts timestamp, event_id long, grade int"
STORED = "user_id long, vocab_id long, ease_factor double, interval int, repetitions int, status string, next_review_date timestamp"


def random_cards(rng, users=4, cards=3):
    return [(u, c, rng.choice([1.3, 1.36, 1.5, 2.5, 2.8]), rng.choice([0, 1, 1, 2, 6, 30]), rng.choice([0, 1, 2, 5]), "reviewing", datetime(2023, 12, 1))
            for u in range(users) for c in range(cards) if rng.random() < 0.7]


def test_late_ratings_from_stored_cards_equal_batch(spark, replay):
    """Micro-batches out of order; the last event only moves the watermark on."""
    rng = random.Random(12)
    start = random_cards(rng)
    rows = [(rng.randint(0, 3), rng.randint(0, 2), datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 40) * 7000, microseconds=i % 3), i, rng.choice([0, 2, 3, 4, 5]))
            for i in range(160)]
    rows += [(0, 0, None, 500, 5), (0, None, datetime(2024, 1, 1), 501, 5), (0, 0, datetime(2024, 1, 1), 502, None)]
    rng.shuffle(rows)
    end = [(-1, -1, datetime(2024, 3, 1), 999, 5)]
    progress = spark.createDataFrame(start, STORED)
    emitted = replay([rows[:60], rows[60:90], rows[90:], end], RATINGS, lambda s: jobs.stream_rate_cards(s, progress, "10 days"), "update")
    last, refused = {}, 0
    for _, r in sorted((e for e in emitted if e[1].ratings), key=lambda e: e[1].ratings):
        last[(r.user_id, r.vocab_id)] = (r.ease_factor, r.interval, r.repetitions, r.status, r.ratings, r.next_review_date)
    refused = sum(r.refused for _, r in emitted)
    cards, rejects = learning.rate_cards(progress, spark.createDataFrame([r for r in rows if r[2]], RATINGS))
    assert last == {(r.user_id, r.vocab_id): (r.ease_factor, r.interval, r.repetitions, r.status, r.ratings, r.next_review_date)
                    for r in cards.collect() if r.ratings}
    assert refused == rejects.filter("reason = 'progress_not_found'").count() > 0


def test_late_corrections_from_stored_pages_equal_batch(spark, replay):
    rng = random.Random(6)
    schema = "page_id long, position long, base_revision long, corrected_text string, submitted_at timestamp"
    rows = [(rng.randint(0, 3), i, None if i == 7 else max(-1, i // 6 + 2 + rng.randint(-1, 1)), "t" if rng.random() < 0.9 else " ", datetime(2024, 1, 1) + timedelta(minutes=i * 9))
            for i in range(90)]
    p = spark.createDataFrame([(0, 2, "raw"), (1, 2, "raw"), (2, 0, "raw")], "page_id long, revision long, raw_text string")
    batch = pages.apply_corrections(p, spark.createDataFrame(rows, schema)).collect()
    rng.shuffle(rows)
    end = [(9, 999, 0, "t", datetime(2024, 3, 1))]
    emitted = replay([rows[:25], rows[25:50], rows[50:], end], schema, lambda s: jobs.stream_ordered_corrections(s, p, "2 days"), "append")
    assert len(emitted) == len(rows)
    assert {(r.page_id, r.position): (r.outcome, r.revision) for _, r in emitted} == {
        (r.page_id, r.position): (r.outcome, r.revision if r.outcome in ("accepted", "stale") else None) for r in batch}


def test_study_log_stream(spark, replay):
    schema = "user_id long, vocab_id long, ts timestamp, event_id long, grade int"
    rows = [(1, 1, datetime(2024, 1, 1 + i // 10, i % 10), i, 5) for i in range(30)]
    emitted = replay([rows], schema, jobs.stream_study_log, "update")
    assert {str(r.day): r.words_reviewed for _, r in emitted} == {"2024-01-01": 10, "2024-01-02": 10, "2024-01-03": 10}


def test_corrections_stream_equals_batch(spark, replay):
    rng = random.Random(4)
    schema = "page_id long, position long, base_revision long, corrected_text string"
    rows = [(rng.randint(0, 2), i, max(0, i // 6 + rng.randint(-1, 1)), "t" if rng.random() < 0.9 else " ") for i in range(60)]
    emitted = replay([rows[:25], rows[25:]], schema, jobs.stream_corrections, "append")
    p = spark.createDataFrame([(i, 0, "raw") for i in range(3)], "page_id long, revision long, raw_text string")
    batch = pages.apply_corrections(p, spark.createDataFrame(rows, schema)).collect()
    assert {(r.page_id, r.position): (r.outcome, r.revision) for _, r in emitted} == {(r.page_id, r.position): (r.outcome, r.revision) for r in batch}


def test_ingest_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [word_row(i, *w) for i, w in enumerate(random_rows(rng, 60, **POOL))]
    src = tmp_path / "words"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, WORDS).coalesce(1).write.mode("append").parquet(str(src))
    state = {"v": spark.createDataFrame([], VOCAB), "r": spark.createDataFrame([], REVIEWS), "n": []}

    def write(result, batch_id):
        path = tmp_path / f"snapshot{batch_id}"
        result.vocabulary.write.parquet(str(path / "v"))
        result.reviews.write.parquet(str(path / "r"))
        state.update(v=spark.read.parquet(str(path / "v")), r=spark.read.parquet(str(path / "r")))
        state["n"].append(batch_id)

    stream = spark.readStream.schema(WORDS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = jobs.stream_ingest(stream, lambda: (state["v"], state["r"]), write, str(tmp_path / "cp"))
    q.awaitTermination()
    assert state["n"] == [0, 1]
    first = plain.ingest(as_dicts(rows[:30], WORDS), [])
    assert state["v"].filter("id <= 30").count() == sum(k == "new" for k, _, _ in first.values())
    assert state["v"].groupBy("canonical_key").count().filter("count > 1").count() == 0
    assert state["r"].filter(F.col("status") != "pending").count() == 0


def tables_of(store):
    return {n: sorted(map(str, df.collect())) for n, df in store.read().items()}


def test_a_repeated_ingest_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [word_row(i, *w) for i, w in enumerate(random_rows(rng, 40, **POOL))]
    store = Snapshots(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read()
    for _ in range(2):  # a second start keeps what is there
        store.start({"vocabulary": spark.createDataFrame([], VOCAB), "reviews": spark.createDataFrame([], REVIEWS)})
    run = jobs.ingest_once(store, "words")
    batches = [spark.createDataFrame(rows[:25], WORDS), spark.createDataFrame(rows[25:], WORDS)]
    run(batches[0], 0)
    first = tables_of(store)
    run(batches[0], 0)
    assert tables_of(store) == first and store.records() == [(0, "start", 0), (1, "words", 0)]
    # an attempt that was lost before its record: its version does not count and is overwritten
    batches[0].limit(3).write.parquet(str(tmp_path / "store" / "v=2" / "vocabulary"))
    assert tables_of(store) == first
    run(batches[1], 1)
    second = tables_of(store)
    run(batches[1], 1)
    run(batches[0], 0)
    assert tables_of(store) == second != first
    # the same batch number of another stream is another batch
    jobs.ingest_once(store, "more")(batches[0], 0)
    assert store.records()[-1] == (3, "more", 0)
    assert len(tables_of(store)["vocabulary"]) == len(second["vocabulary"])


def test_words_delivered_twice_are_ingested_once(spark, tmp_path):
    rng = random.Random(7)
    rows = [(*word_row(i, *w), datetime(2024, 1, 1) + timedelta(minutes=i)) for i, w in enumerate(random_rows(rng, 30, **POOL))]
    schema = WORDS + ", arrived_at timestamp"
    results = []
    for name, parts in (("once", [rows[:20], rows[20:]]), ("twice", [rows[:20], rows[5:15] + rows[20:]])):
        src, store = tmp_path / name, Snapshots(spark, str(tmp_path / f"{name}-store"))
        store.start({"vocabulary": spark.createDataFrame([], VOCAB), "reviews": spark.createDataFrame([], REVIEWS)})
        for part in parts:  # the stream stops and goes on from its checkpoint
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
            jobs.stream_ingest_once(spark.readStream.schema(schema).parquet(str(src)), store, "words", str(tmp_path / f"{name}-cp")).awaitTermination()
        assert [r[1] for r in store.records()] == ["start", "words", "words"]
        results.append(tables_of(store))
    assert results[0] == results[1] and results[0]["vocabulary"]
