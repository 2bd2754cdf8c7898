"""Findings of round 8."""

from pyspark.sql import functions as F

from lexiloom.session import cut_lineage, tune


def final_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_broadcasts_follow_measured_sizes(spark, tmp_path):
    """Rows that are far smaller as a file than in memory are not broadcast, few rows still are."""
    tune(spark)
    path = str(tmp_path / "rows")
    spark.range(400_000).select("id", F.lit("much the same meaning " * 5).alias("meaning")).coalesce(1).write.parquet(path)
    rows = cut_lineage(spark.read.parquet(path))
    words = spark.range(900_000).select((F.col("id") * 3).alias("id"))
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10 << 20  # what a planned broadcast would go by
    for held, n, broadcast in ((rows, 133_334, False), (rows.filter("id < 500"), 167, True)):
        met = words.join(held, "id").agg(F.count(F.lit(1)), F.sum(F.length("meaning")))
        assert met.first() == (n, n * 110)
        met.collect()
        assert ("BroadcastHashJoin" in final_plan(met)) is broadcast
