"""The clock of a segment as a line: camera seconds by position, fitted to its readings.

A segment is what lies between two boundaries of a tape. The line is a least-squares fit from sums, which Spark adds up
in parts; positions and clocks are counted from the segment's first reading, so that the sums stay exact. Segments of
fewer than `model_readings` readings, or with one position only, have no line.

Repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.values import clock
from tidemark.operators.joins import asof


def segmented(filtered: DataFrame, found: DataFrame) -> DataFrame:
    """filtered (tape_id, video_t, cam_ts) with segment: the boundary (tape_id, boundary_id, video_t) at or before the reading, 0 before the first."""
    out = asof(filtered, found.select("tape_id", F.col("video_t").alias("at"), "boundary_id"), "video_t", "at", "__b")
    return out.withColumn("segment", F.coalesce("__b.boundary_id", F.lit(0)).cast("bigint")).drop("__b")


def models(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, segment, n, t0, c0, slope, intercept) of segmented readings: a clock is c0 + slope * (position - t0) + intercept; slope and intercept are null without a fit."""
    key = ["tape_id", "segment"]
    first = readings.groupBy(*key).agg(F.min(F.struct("video_t", clock(F.col("cam_ts")).alias("c"))).alias("first"))
    x, y = F.col("video_t") - F.col("first.video_t"), (clock(F.col("cam_ts")) - F.col("first.c")).cast("double")
    points = readings.join(first, key).select(*key, F.col("first.video_t").alias("t0"), F.col("first.c").alias("c0"), x.alias("x"), y.alias("y"))
    sums = points.groupBy(*key, "t0", "c0").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")))])
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    fits = (F.col("n") >= settings.model_readings) & (spread > 0)
    slope = F.when(fits, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    return sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).select(*key, "n", "t0", "c0", "slope", "intercept")


def residuals(readings: DataFrame, of: DataFrame) -> DataFrame:
    """Segmented readings with residual_s, how far their clock is from their segment's line; null without one."""
    out = readings.join(of.drop("n"), ["tape_id", "segment"], "left")
    expected = F.col("c0") + F.col("slope") * (F.col("video_t") - F.col("t0")) + F.col("intercept")
    return out.withColumn("residual_s", F.abs(clock(F.col("cam_ts")) - expected)).drop("t0", "c0", "slope", "intercept")


def drop_misfits(readings: DataFrame, of: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Segmented readings without those further than model_residual_s from their segment's line."""
    return residuals(readings, of).where(F.coalesce(F.col("residual_s") <= settings.model_residual_s, F.lit(True))).drop("residual_s")


def predictions(samples: DataFrame, readings: DataFrame, of: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, video_t, segment, cam_ts, source) of samples (tape_id, video_t) without a reading: the line's clock, in whole seconds, source 'model'.

    Only in gaps of at most dead_zone seconds between two readings of one segment that has a line.
    """
    known = readings.select("tape_id", F.col("video_t").alias("at"), "segment")
    out = samples.select("tape_id", "video_t").join(readings.select("tape_id", "video_t").distinct(), ["tape_id", "video_t"], "left_anti")
    out = asof(asof(out, known, "video_t", "at", "__b"), known, "video_t", "at", "__a", forward=True)
    gap = (F.col("__a.segment") == F.col("__b.segment")) & (F.col("__a.at") - F.col("__b.at") <= settings.dead_zone)
    out = out.where(gap).select("tape_id", "video_t", F.col("__b.segment").alias("segment")).join(of.where("slope IS NOT NULL"), ["tape_id", "segment"])
    at = F.floor(F.col("c0") + F.col("slope") * (F.col("video_t") - F.col("t0")) + F.col("intercept"))
    when = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=at.cast("decimal(18,6)"))
    return out.select("tape_id", "video_t", "segment", when.alias("cam_ts"), F.lit("model").alias("source"))
