"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a session on one machine that has none gets one (tests)."""
    found = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{KEY} names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set(KEY, found)
    return f"{found.rstrip('/')}/folioflow/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rename(spark: SparkSession, folder: str, to: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, spark._jvm.org.apache.hadoop.fs.Path(to))


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it several times does not compute it again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
