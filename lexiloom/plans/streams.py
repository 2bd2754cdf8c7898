"""Streaming queries: each runs over everything available and returns what it emitted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from ..streaming import jobs
from ..streaming.snapshots import Snapshots
from . import resolution, study, views as v, workflow


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """Stream of a table that is one file or a folder of files; the pattern takes either, a plain path only a folder."""
    schema = v.table(spark, sf, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}[.]parquet")


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end into files of the shared folder; adds the micro-batch number."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    query = (df.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("part")


def _arrivals(df: DataFrame, group: str) -> DataFrame:
    """Stream of ``df`` in which rows arrive by ascending ``group`` (a few numbers), over several micro-batches.

    A group is as many files as a micro-batch takes, so their number follows the groups and not the table's size.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    columns, files = df.drop(group), spark.sparkContext.defaultParallelism
    for (n,) in df.select(group).distinct().orderBy(group).collect():
        df.filter(F.col(group) == n).drop(group).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _unordered(df: DataFrame, at: str, id_: str, end: dict) -> DataFrame:
    """Rows arrive about in order of ``at``, up to six days late, and last a row ``end`` a year on, which moves the watermark."""
    day = F.unix_timestamp(at) / 86_400
    late = F.floor((day + F.pmod(F.xxhash64(id_), F.lit(144)) / 24) / 8).cast("long").alias("_arrival")
    closing = {**{c: F.lit(None) for c in df.columns}, **end, at: F.col("_last") + F.expr("interval 366 days")}
    last = df.agg(F.max(at).alias("_last")).select(
        *[closing[f.name].cast(f.dataType).alias(f.name) for f in df.schema], F.lit((1 << 62)).alias("_arrival"))
    return _arrivals(df.select("*", late).unionByName(last), "_arrival")


def stream_rate_cards(spark, sf):
    """Ratings in no strict order, over several micro-batches, on stored cards: the newest state of each rated card."""
    jobs.use_rocksdb(spark)
    ratings = v.ratings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    given = _unordered(ratings, "ts", "event_id", {"user_id": F.lit(-9), "vocab_id": F.lit(-9), "grade": F.lit(5)})
    out = _run(jobs.stream_rate_cards(given, v.stored_cards(spark, sf), "15 days"), "update").filter("ratings > 0")
    newest = out.groupBy("user_id", "vocab_id").agg(F.max_by(F.struct(*out.columns), "ratings").alias("s")).select("s.*")
    return v.plain(newest.drop("batch", "refused"))


def stream_ordered_corrections(spark, sf):
    """Submissions of pages in no strict order; pages of every ninth conversation are unknown."""
    jobs.use_rocksdb(spark)
    given = v.submissions(spark, sf).withColumn("submitted_at", F.timestamp_seconds(
        F.unix_timestamp(F.lit(v.EPOCH).cast("timestamp")) + F.col("position") * 86_400 + F.col("page_id") % 86_400))
    pages = given.select("page_id").distinct().filter("page_id % 9 <> 0").withColumn("revision", F.lit(0))
    arriving = _unordered(given, "submitted_at", "page_id", {"page_id": F.lit(-9), "position": F.lit(0), "corrected_text": F.lit("end"), "base_revision": F.lit(0)})
    return v.plain(_run(jobs.stream_ordered_corrections(arriving, pages, "15 days"), "append").drop("batch"))


def stream_ingest_once(spark, sf):
    """Words in three parts, some delivered twice, ingested part by part into committed versions of the tables."""
    base = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    words = v.words(spark, sf).withColumn("arrived_at", F.timestamp_seconds(
        F.unix_timestamp(F.lit(v.EPOCH).cast("timestamp")) + F.col("position") * 60))
    top = words.agg(F.max("position")).scalar()
    part = F.floor(F.col("position") * 3 / (top + 1))
    again = words.filter("position % 50 = 7").withColumn("part", part + 1).filter("part < 3")
    given = words.withColumn("part", part).unionByName(again)
    store = Snapshots(spark, f"{base}/tables")
    store.start({"vocabulary": v.vocab(spark, sf), "reviews": v.reviews(spark, sf).limit(0)})
    for n in range(3):  # the stream is started again for each part, from its checkpoint
        given.filter(F.col("part") == n).drop("part").write.mode("append").parquet(f"{base}/words")
        arriving = spark.readStream.schema(words.schema).parquet(f"{base}/words")
        jobs.stream_ingest_once(arriving, store, "words", f"{base}/checkpoint", "60 days").awaitTermination()
    grown = store.read()["vocabulary"]
    return v.plain(grown.select("id", v.visible("canonical_key").alias("canonical_key"), "kanji", "kana", "lesson"))


def stream_sm2(spark, sf):
    jobs.use_rocksdb(spark)
    ratings = v.ratings_of(_stream(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(jobs.stream_sm2(ratings), "update")
    newest = out.groupBy("user_id", "vocab_id").agg(F.max_by(F.struct(*out.columns), "batch").alias("s")).select("s.*")
    return v.plain(newest.drop("batch", "rated_at"))


def stream_study_log(spark, sf):
    ratings = v.ratings_of(_stream(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(jobs.stream_study_log(ratings), "update")
    return v.plain(out.groupBy("user_id", "day").agg(F.max_by("words_reviewed", "batch").alias("words_reviewed")))


def stream_corrections(spark, sf):
    jobs.use_rocksdb(spark)
    out = _run(jobs.stream_corrections(v.submissions_of(_stream(spark, sf, "conversations"))), "append")
    return v.plain(out.select("page_id", "position", "outcome", "revision"))


def stream_ingest(spark, sf):
    """Ingest the word stream into the stored vocabulary; a snapshot is written per batch."""
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    state = {"vocabulary": v.vocab(spark, sf), "reviews": v.reviews(spark, sf).limit(0)}

    def write(result, number: int) -> None:
        for name in state:
            path = f"{base}/{name}/{number}"
            getattr(result, name).write.mode("overwrite").parquet(path)
            state[name] = spark.read.parquet(path)

    query = jobs.stream_ingest(
        v.words_of(_stream(spark, sf, "part")), lambda: (state["vocabulary"], state["reviews"]), write, f"{base}/checkpoint")
    query.awaitTermination()
    return v.plain(state["vocabulary"].select("id", v.visible("canonical_key").alias("canonical_key"), "kanji", "kana", "lesson"))


LOG = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS words_reviewed FROM ratings WHERE grade IN (0, 3, 4, 5) GROUP BY 1, 2"

# The sequential fold on pages that start at revision 0, unknown ones apart.
ORDERED = """
    SELECT page_id, position, CASE WHEN outcome = 'invalid' OR page_id % 9 <> 0 THEN outcome ELSE 'page_not_found' END AS outcome,
      CASE WHEN outcome <> 'invalid' AND page_id % 9 <> 0 THEN revision END AS revision FROM done"""

RATED = "WITH " + study.RATE_CARDS.strip() + " WHERE i > 0"


def _parts(n: int) -> str:
    """The ingest rule applied part by part: the vocabulary that one part leaves is the next one's."""
    rows = "SELECT id, canonical_key, kanji, kana, lesson, burmese_meaning, surface_key, identity_key FROM vocab"
    for k in range(n):
        source = f"vocab AS ({rows.replace('FROM vocab', 'FROM first_vocab') if k == 0 else rows}), words AS (SELECT * FROM all_words WHERE position * {n} // (top + 1) = {k})"
        rows = f"""
          SELECT id, canonical_key, kanji, kana, lesson, burmese_meaning, replace(coalesce(kanji, ''), ' ', '') AS surface_key, {v.key_sql('kanji', 'kana')} AS identity_key
          FROM (WITH RECURSIVE {source}, {resolution.MATCH.strip()} {resolution.INGEST}
            SELECT r.id, coalesce(canonical_key, k) AS canonical_key, coalesce(kanji, s) AS kanji, kana, coalesce(lesson, l) AS lesson, burmese_meaning
            FROM (SELECT id, canonical_key, kanji, kana, lesson, burmese_meaning FROM vocab
              UNION ALL SELECT (SELECT max(id) + 1 FROM stored) + position, identity_key, kanji, kana, lesson, burmese_meaning
                FROM result JOIN words USING (position) WHERE kind = 'new') r
            LEFT JOIN (SELECT existing_id AS id, max_by(identity_key, position) AS k, max_by(kanji, position) FILTER (kanji IS NOT NULL) AS s,
                max_by(lesson, position) FILTER (lesson IS NOT NULL) AS l
              FROM result JOIN words USING (position) WHERE kind IN ('exact', 'enrich') GROUP BY 1) u ON u.id = r.id)"""
    return v.with_views(
        "WITH all_words AS (SELECT *, max(position) OVER () AS top FROM words), first_vocab AS (SELECT * FROM vocab), done AS (" + rows
        + ") SELECT id, replace(canonical_key, chr(0), '|') AS canonical_key, kanji, kana, lesson FROM done", "vocab", "words", recursive=True)


QUERIES = {
    "stream_rate_cards": (stream_rate_cards, v.with_views(RATED, "ratings", "stored_cards", recursive=True)),
    "stream_ordered_corrections": (stream_ordered_corrections, workflow._fold(ORDERED)),
    "stream_ingest_once": (stream_ingest_once, _parts(3)),
    "stream_sm2": (stream_sm2, study.QUERIES["sm2_replay"][1]),
    "stream_study_log": (stream_study_log, v.with_views(LOG, "ratings")),
    "stream_corrections": (stream_corrections, workflow._fold("SELECT page_id, position, outcome, revision FROM done")),
    "stream_ingest": (stream_ingest, resolution._ingest(resolution.GROWN)),
}
