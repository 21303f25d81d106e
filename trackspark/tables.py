"""Cuts of a long lineage: tables in the folder that every executor of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one machine (a local master) takes a temporary folder, and a cluster raises ValueError."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trackspark-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def fresh_path(spark: SparkSession, what: str, folder: str | None = None) -> str:
    return f"{folder or shared_dir(spark)}/trackspark-{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str = "table", folder: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: what several steps read is computed once."""
    path = fresh_path(df.sparkSession, what, folder)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
