"""Session settings for batch work on large logs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # late stages read the shuffle in pieces of this size; fits executor memory at any data scale
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # rows here are up to 120 columns wide: generated methods beyond what the JVM compiles would run
    # interpreted, so let such stages run without whole-stage generation
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "dugout", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own master and memory settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DUGOUT_DRIVER_MEMORY", "8g"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def wide_rows(spark: SparkSession) -> None:
    """For plans over rows of some hundred columns: the limit of ``SETTINGS`` on generated methods, also in a
    session that others made, unless it has a lower one. Beyond it the JVM interprets each row's code."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > int(SETTINGS[limit]):
        spark.conf.set(limit, SETTINGS[limit])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names, else (local sessions only) a
    temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="dugout-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so a lost executor costs no recompute of what led here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again. For tables of a row per row of a log: columns lie apart and
    compressed, a reader takes only those it needs, and the caller can ``release`` the folder."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete what ``stored`` wrote and no result reads any more. Shuffles that no plan refers to are deleted
    once the driver's JVM notices, which may be long after the disk is full; it is asked to look."""
    for path in paths:
        drop_path(spark, path)
    spark._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this session has kept in the shared folder. For the end of a run: results not yet
    written elsewhere may still read from it."""
    drop_path(spark, shared_folder(spark))
