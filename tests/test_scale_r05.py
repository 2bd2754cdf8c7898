"""Work per row is dealt over the cores, whatever files a table comes in, and joins carry narrow rows."""

import random

from pyspark.sql import functions as F
from test_matching import REVIEWS, VOCAB, WORDS, word_row

from lexiloom.operators import matching
from lexiloom.plans import views
from lexiloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_words_of_one_row_group_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert views.table(spark, SF, "part").rdd.getNumPartitions() == 1 < cores
    for df in (views.words(spark, SF), views.vocab(spark, SF)):
        assert df.rdd.getNumPartitions() == cores


def test_pairs_meet_in_their_block_alone_unless_it_is_hot(spark, monkeypatch):
    rng = random.Random(5)
    triples = sorted({(rng.choice(["s", "t"]), rng.choice(["abcd", "abcx", "abc", "xbcd", "abdc"]) + rng.choice(["", "q"]),
                       "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for _ in range(250)})
    rows = spark.createDataFrame([(*t, i) for i, t in enumerate(triples)], "surface_key string, reading_key string, meaning_key string, pos long")
    listed, sizes = matching._listed, []

    def counted(side, *rest):
        out = listed(side, *rest)
        sizes.append((side.count(), out.count()))
        return out

    monkeypatch.setattr(matching, "_listed", counted)
    found = [sorted((r.pos, r.ex_id, r.distance, r.similarity) for r in matching.fuzzy_pairs(rows, rows.withColumnRenamed("pos", "ex_id"), chunk).collect())
             for chunk in (10**9, 40, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(set(found[0])) > len(triples)
    assert sizes[0][0] == sizes[0][1] < sizes[4][1]


def test_micro_batches_of_words_run_adaptively(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "ingest", lambda words, *rest, **options: seen.append(
        (words.sparkSession.conf.get("spark.sql.adaptive.enabled"), words.count())))
    src = str(tmp_path / "src")
    spark.createDataFrame([word_row(i, f"s{i}", f"r{i}", "m") for i in range(5)], WORDS).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(WORDS).parquet(src).withColumn("at", F.timestamp_seconds(F.col("position") + 1_000_000)).withWatermark("at", "1 day")
    given = stream.dropDuplicatesWithinWatermark(["position"]).drop("at")
    empty = spark.createDataFrame([], VOCAB), spark.createDataFrame([], REVIEWS)
    jobs.stream_ingest(given, lambda: empty, lambda result, n: None, str(tmp_path / "cp")).awaitTermination()
    assert seen[0] == ("true", 5)
