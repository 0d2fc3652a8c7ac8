"""Tables written between stages, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's part of the folder in spark.checkpoint.dir. Only a session on one machine (tests) may leave the setting out;
    a cluster has no local folder that could take its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later plans start from a file, whatever made it, and an executor
    that is lost takes nothing with it. clear() deletes such tables."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has staged. Results not yet read or written to a place of their own are gone with it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
