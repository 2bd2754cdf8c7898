import os

import pytest
from pyspark.sql import functions as F

from lexiloom.sources.report import named_files, publish_report, read_report

SCHEMA = "id long, name string, note string"


def rows(spark, n, parts=3):
    return spark.range(n).repartition(parts).select("id", F.concat(F.lit("n\n"), "id").alias("name"), F.lit(None).cast("string").alias("note"))


def test_report_is_read_as_written(spark, tmp_path):
    path = str(tmp_path / "report")
    publish_report(rows(spark, 100), path)
    assert sorted(map(tuple, read_report(spark, path, SCHEMA).collect())) == [(i, f"n\n{i}", None) for i in range(100)]
    publish_report(rows(spark, 5), path, append=True)
    assert read_report(spark, path, SCHEMA).count() == 105
    publish_report(rows(spark, 2, 1), path)
    assert sorted(r.id for r in read_report(spark, path, SCHEMA).collect()) == [0, 1]
    assert sorted(f for f in os.listdir(path) if f.startswith("part")) == sorted(f["name"] for f in named_files(path))
    publish_report(rows(spark, 0), path)
    assert read_report(spark, path, SCHEMA).count() == 0
    assert read_report(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_failed_report_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "report")
    publish_report(rows(spark, 10), path)
    before = named_files(path)
    bad = rows(spark, 50, 4).withColumn("name", F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        publish_report(bad, path)
    assert named_files(path) == before and read_report(spark, path, SCHEMA).count() == 10
