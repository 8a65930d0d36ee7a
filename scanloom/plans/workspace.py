"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a
    temporary folder; on a cluster the executors could not read it."""
    configured = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_DIR} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="scanloom-")
    spark.conf.set(_DIR, folder)
    return folder


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and lost
    executors cost nothing that was already written."""
    spark = table.sparkSession
    path = new_dir(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
