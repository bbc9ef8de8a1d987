"""Intermediate tables of the engine, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset and all of Spark is on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at and app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sigspark-")
    return (at or _own[app]).rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that its partitions are fixed and its lineage is short."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/engine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
