"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session of one process that has none set gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="evoframe-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written once as Parquet and read back: later uses don't compute it again, and a lost executor costs its tasks only."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
