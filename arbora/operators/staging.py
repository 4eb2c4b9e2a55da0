"""Cutting lineage: a table in the shared folder instead of a growing plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that ``spark.checkpoint.dir`` names; a temporary one in a session of one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='arbora-graph-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write to the shared folder and read back; survives lost executors."""
    path = folder(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
