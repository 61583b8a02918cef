"""Readings as a stream: parsed as they arrive, counted by minutes of arrival, and cut into clips once a tape is over.

Rules that look ahead (cleaning, boundaries) need a whole tape, so tapes are finished in foreachBatch by the batch
operators; nothing of them is written anew here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import DEFAULTS, Settings
from tidemark.operators.sample import parsed
from tidemark.plans import pipeline

#: Arriving rows; the last of a tape has its duration.
SCHEMA = "tape_id STRING, video_t DOUBLE, raw STRING, arrived TIMESTAMP, duration_s DOUBLE"


def readings(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """A stream of the JSON lines in a folder, with cam_ts and minute."""
    return parsed(spark.readStream.schema(SCHEMA).json(path), settings)


def yields(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, tape_id, n, n_read) by windows of arrival; rows later than `late` are left out."""
    counted = stream.withWatermark("arrived", late).groupBy(F.window("arrived", width), "tape_id").agg(F.count("*").alias("n"), F.count_if(F.col("cam_ts").isNotNull() | F.col("minute").isNotNull()).alias("n_read"))
    return counted.select(F.col("window.start").alias("start"), "tape_id", "n", "n_read")


def finish_tapes(stream: DataFrame, kept_path: str, emit: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Keeps rows in kept_path, one folder for each batch, and emits the clips of tapes whose last row has arrived.

    A batch that is run again replaces its folder, so rows are kept once; emit gets the batch's number for the same end.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("tape_id", "video_t", "raw", "duration_s").write.mode("overwrite").parquet(f"{kept_path}/batch={number}")
        over = spark.read.parquet(f"{kept_path}/batch={number}").where("duration_s IS NOT NULL").select("tape_id", "duration_s").distinct()
        if not over.isEmpty():
            rows = spark.read.option("basePath", kept_path).parquet(kept_path).where(F.col("batch") <= number)
            own = rows.join(over.select("tape_id"), "tape_id", "left_semi")
            emit(pipeline.dry_run(own, over, settings).clips, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
