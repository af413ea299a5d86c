"""The folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` write to the folder in ``spark.checkpoint.dir``; only a session on one machine has a default."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    spark.sparkContext.setCheckpointDir(base)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files below the checkpoint folder: they outlive executors, and later plans know their sizes."""
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
