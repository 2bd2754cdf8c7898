"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return measured_broadcasts(spark)


#: Bytes that rows take in memory for each byte of their file, at most, as a planned broadcast has to reckon.
PACKED = 40


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Leave broadcasts to adaptive execution, up to the size that the session allows; only the smallest are planned.

    A planned one goes by the size of files, and a row takes many times as much in memory: a million words of 8 MB
    as Parquet were sent to all executors through the driver.  A session that names the adaptive limit keeps its own.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set(measured, str(limit))
        spark.conf.set(planned, str(limit // PACKED if limit > 0 else limit))
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for tests and the local benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lexiloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return measured_broadcasts(spark)


def spread(df: DataFrame, pieces: int = 4) -> DataFrame:
    """Deal a table's rows out where it comes in few pieces, before work that is heavy for each row.

    A file's row group is one task, however many cores there are.  A table of ``pieces`` files or splits for
    each core, as any large one is, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < pieces * cores else df


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is made only when the session names none and runs in local mode.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _LOCAL_FOLDERS.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL_FOLDERS[sc.applicationId] = folder
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
