"""A folder that the driver and all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where none is configured, a local one is set for a local master, as in tests; on a cluster that is an error, as
    executors couldn't write where the driver reads."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/panel-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table written once to a new shared folder and read from there, for a plan that reads it several times."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
