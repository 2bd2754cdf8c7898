"""Streams over many keys: state and micro-batches do not multiply with cards or files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexiloom.operators import learning
from lexiloom.plans import streams
from lexiloom.streaming import jobs

RATINGS = "user_id long, vocab_id long, ts timestamp, event_id long, grade int"


def run(stream, path, mode="update"):
    out = []
    q = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend((n, r) for r in df.collect()))
         .option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    return out, q


def test_cards_of_the_sm2_stream_share_state_rows(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rows = [(None if i % 50 == 0 else i % 700, i % 3, None if i == 1402 else datetime(2024, 1, 1) + timedelta(hours=i % 400), i, (0, 3, 4, 5)[i * 7 % 4])
            for i in range(3000)]
    src = str(tmp_path / "src")
    for part in (rows[:2000], rows[2000:]):
        spark.createDataFrame(part, RATINGS).coalesce(1).write.mode("append").parquet(src)
    out, q = run(jobs.stream_sm2(spark.readStream.schema(RATINGS).option("maxFilesPerTrigger", 1).parquet(src)), tmp_path)
    last = {}
    for _, r in sorted(out, key=lambda e: e[0]):
        last[(r.user_id, r.vocab_id)] = r.ratings
    batch = {(r.user_id, r.vocab_id): r.ratings for r in learning.replay_sm2(spark.createDataFrame(rows, RATINGS)).collect()}
    assert last == batch and len(batch) > 2 * jobs.CARD_BUCKETS
    assert q.lastProgress.stateOperators[0].numRowsTotal <= jobs.CARD_BUCKETS


def test_waiting_ratings_share_state_rows(spark, tmp_path):
    """Half the ratings still wait; each of 2,000 cards has one, all in one day."""
    jobs.use_rocksdb(spark)
    rows = [(u, 1, datetime(2024, 1, 1) + timedelta(seconds=u * 30), u, 4) for u in range(2000)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, RATINGS).coalesce(1).write.parquet(src)
    spark.createDataFrame([(-9, -9, datetime(2024, 1, 1, 8, 20) + timedelta(hours=1), 9999, 5)], RATINGS).coalesce(1).write.mode("append").parquet(src)
    progress = spark.range(2000).select(
        F.col("id").alias("user_id"), F.lit(1).cast("long").alias("vocab_id"), F.lit(2.5).alias("ease_factor"), F.lit(6).alias("interval"), F.lit(2).alias("repetitions"))
    stream = spark.readStream.schema(RATINGS).option("maxFilesPerTrigger", 1).parquet(src)
    out, q = run(jobs.stream_rate_cards(stream, progress, "8 hours"), tmp_path)
    # the last watermark is 00:40 past the first file's newest rating, less eight hours
    passed = datetime(2024, 1, 1) + timedelta(seconds=1999 * 30) - timedelta(hours=8)
    whole = passed.replace(second=0, microsecond=0)
    assert sorted(r.user_id for _, r in out) == [u for u, _, ts, _, _ in rows if ts < whole]
    assert all((r.interval, r.repetitions, r.ratings) == (15, 3, 1) for _, r in out)
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 5 * jobs.CARD_BUCKETS


def test_files_of_a_table_do_not_multiply_micro_batches(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 3).alias("group")).repartition(40)
    batches = run(streams._arrivals(rows, "group"), tmp_path, "append")[0]
    assert sorted(r.id for _, r in batches) == list(range(4000))
    assert len({n for n, _ in batches}) == 3
    assert [{r.id % 3 for n, r in batches if n == k} for k in range(3)] == [{0}, {1}, {2}]
