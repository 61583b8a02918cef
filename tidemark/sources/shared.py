"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders named here and not yet dropped.
_named: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster names; a temporary one only for a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession) -> None:
    """Deletes the folders named here, once nothing reads them any more."""
    while _named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_named.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
