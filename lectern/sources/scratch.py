"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine without it a temporary folder, on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return place or tempfile.mkdtemp(prefix="spark-shared-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps don't recompute it and survive lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
