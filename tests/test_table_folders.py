"""Registered streams over tables that are folders of files."""

import shutil

from lexiloom.plans import streams


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    given = "/root/testdata/sf0.001/conversations.parquet"
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    shutil.copyfile(given, one / "conversations.parquet")
    spark.read.parquet(given).repartition(3).write.parquet(str(many / "conversations.parquet"))
    results = [sorted(map(tuple, streams.stream_corrections(spark, str(d)).collect()), key=repr) for d in (one, many)]
    assert results[0] == results[1] and results[0]
