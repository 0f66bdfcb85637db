"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="scratch-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder of this machine if Spark runs on it alone (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_dir(spark)}/assetlens-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path there."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to scratch and read back: what is computed from it starts from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch data of this application, its chunk tables included; its DataFrames can't be read any more."""
    for t in spark.catalog.listTables():
        if t.name.startswith("assetlens_chunks_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    delete(spark, own_dir(spark))
