"""Scans kept by tape and settings, and clips written by tape: both can be run again.

A store is a folder of two tables. `samples` has a partition for each settings key and tape, `entries` the tapes that
were scanned to their end. A tape without an entry for the settings asked for is scanned, its partition replaced as a
whole, and its entry written last, so a run that broke off leaves nothing that counts and nothing that is doubled. A
changed setting has another key; what other settings left stays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings

_SAMPLES = "video_t DOUBLE, raw STRING, key STRING, tape_id STRING"
_ENTRIES = "tape_id STRING, key STRING"


def settings_key(settings: Settings = DEFAULTS, vf_preprocess: str = "") -> str:
    """What scans made with equal settings have in common."""
    parts = {"cache_format": settings.cache_format, "interval": settings.interval, "crop": settings.crop, "frames_per_sample": settings.frames_per_sample, "vf_preprocess": vf_preprocess}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """df written into a table at path: the partitions that df has rows of are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def scanned(tapes: DataFrame, path: str, scan: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULTS, vf_preprocess: str = "") -> DataFrame:
    """(tape_id, video_t, raw) of tapes (tape_id, …): from the store, after those without an entry for the settings were scanned.

    scan gets the tapes to scan, and isn't called if there are none. A tape without samples has an entry all the same.
    """
    spark, key = tapes.sparkSession, settings_key(settings, vf_preprocess)
    known = _table(spark, f"{path}/entries", _ENTRIES).where(F.col("key") == key).select("tape_id")
    missing = tapes.join(known, "tape_id", "left_anti")
    if not missing.isEmpty():
        found = scan(missing).select("video_t", "raw", F.lit(key).alias("key"), "tape_id")
        replace_partitions(found, f"{path}/samples", ["key", "tape_id"])
        missing.select("tape_id", F.lit(key).alias("key")).write.mode("append").parquet(f"{path}/entries")
    rows = _table(spark, f"{path}/samples", _SAMPLES).where(F.col("key") == key)
    return rows.join(tapes.select("tape_id"), "tape_id", "left_semi").select("tape_id", "video_t", "raw")


def write_by_tape(df: DataFrame, path: str, tapes: DataFrame) -> None:
    """df (tape_id, …) of tapes into the table at path: rows of an earlier run of these tapes are gone, also where a tape has none now; other tapes' stay.

    A tape without rows has one with nulls in all other columns, which by_tape leaves out.
    """
    none = tapes.select("tape_id").join(df.select("tape_id"), "tape_id", "left_anti")
    replace_partitions(df.unionByName(none, allowMissingColumns=True), path, ["tape_id"])


def by_tape(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows in a table of write_by_tape; key is a column that is never null in a row."""
    return spark.read.parquet(path).where(F.col(key).isNotNull()).withColumn("tape_id", F.col("tape_id").cast("string"))
