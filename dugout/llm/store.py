"""Tables kept in the folder that all executors share, and what Python workers need to import."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from dugout.session import scratch_path

BATCH = "8m"  # bytes of an Arrow batch
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package beside the driver's own path (clusters ship it with
    ``--py-files``; then the folder does not exist there, which does no harm), and hand them a few
    megabytes at once, however long the texts are."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: what reads the result survives lost executors without repeating what led
    here, reads only the columns it needs, and has its size known to the planner.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
