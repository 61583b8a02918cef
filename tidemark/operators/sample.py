"""From frames to samples: buckets of frames, their vote, the second pass, and dates of readings that have a time only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import parse
from tidemark.functions.values import bottom_band


#: The order of a tape's dated rows as SQL has it: by_time()'s.
ORDER = "video_t, cam_ts"


def by_time(tie: str = "cam_ts") -> WindowSpec:
    """A tape in the order of its positions; rows at one position in the order of another column, nulls first."""
    return Window.partitionBy("tape_id").orderBy("video_t", tie)


def parsed(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """samples (tape_id, video_t, raw) with cam_ts and minute (of the day, where there is a time only)."""
    return parse.with_reading(samples, "raw", settings)


def bucket(frame_idx: Column, settings: Settings = DEFAULTS) -> Column:
    return F.floor(frame_idx / settings.frames_per_sample).cast("int")


def _votes(frames: DataFrame, by: list[str], settings: Settings) -> DataFrame:
    """(by…, best, timed, last, n_frames) of frames (…, frame_idx, raw); all groupings go by one shuffle of the buckets."""
    own = parsed(frames.withColumn("bucket", bucket(F.col("frame_idx"), settings)), settings).repartition("tape_id", "bucket")
    readings = own.groupBy(*by, "cam_ts").agg(
        F.count("*").alias("n"),
        F.min(F.struct("frame_idx", "raw")).alias("first"),
        F.max("frame_idx").alias("last"),
        F.min(F.when(F.col("minute").isNotNull(), F.struct("frame_idx", "raw"))).alias("timed"),
    )
    best = F.max(F.when(F.col("cam_ts").isNotNull(), F.struct("n", (-F.col("first.frame_idx")).alias("rank"), "cam_ts", F.col("first.raw").alias("raw"))))
    return readings.groupBy(*by).agg(best.alias("best"), F.min("timed").alias("timed"), F.max("last").alias("last"), F.sum("n").alias("n_frames"))


def _position(last: Column, settings: Settings) -> Column:
    return last * settings.interval / settings.frames_per_sample


def vote(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, bucket, video_t, cam_ts, raw, n_frames) of frames (tape_id, frame_idx, raw).

    The timestamp that most frames read, on ties the one read first, with the text of its first frame; without any,
    the first text with a time only; else nulls. video_t is the position of the bucket's last frame. Of repeated
    frames each counts, and the text that sorts first is its frame's; no frames give no rows.
    """
    out = _votes(frames.select("tape_id", "frame_idx", "raw"), ["tape_id", "bucket"], settings)
    return out.select("tape_id", "bucket", _position(F.col("last"), settings).alias("video_t"), F.col("best.cam_ts").alias("cam_ts"), F.coalesce("best.raw", "timed.raw").alias("raw"), "n_frames")


def two_phase(primary: DataFrame, fallback: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Votes of the primary frames; buckets that they don't solve take the fallback's, if both passes have as many frames of the tape.

    Both passes are one table and vote once; a tape's frames are counted before, so that no tape meets in one task.
    """
    both = primary.select("tape_id", "frame_idx", "raw", F.lit(False).alias("second")).unionByName(fallback.select("tape_id", "frame_idx", "raw", F.lit(True).alias("second")))
    votes = _votes(both, ["tape_id", "bucket", "second"], settings).select("tape_id", "bucket", "second", "last", "n_frames", F.struct(F.col("best.cam_ts").alias("cam_ts"), F.coalesce("best.raw", "timed.raw").alias("raw")).alias("vote"))
    of = lambda c, second: F.max(F.when(F.col("second") == second, F.col(c)))
    pairs = votes.groupBy("tape_id", "bucket").agg(of("last", False).alias("last"), of("vote", False).alias("own"), of("vote", True).alias("other")).where("own IS NOT NULL")
    signed = F.when(F.col("second"), -1).otherwise(1)
    unequal = both.groupBy("tape_id").agg(F.sum(signed).alias("more")).where("more <> 0").select("tape_id", F.lit(True).alias("unequal"))
    solved = F.col("own.raw").isNotNull()
    chosen = F.when(solved | F.coalesce("unequal", F.lit(False)), F.col("own")).otherwise(F.col("other"))
    return pairs.join(unequal, "tape_id", "left").withColumn("chosen", chosen).select("tape_id", "bucket", _position(F.col("last"), settings).alias("video_t"), F.col("chosen.cam_ts").alias("cam_ts"), F.col("chosen.raw").alias("raw"), solved.alias("solved_first"))


def fill_time_only(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """samples (…, cam_ts, minute) whose time-only rows get the date of the last dated row before, plus one day for each midnight passed since.

    Rows before the first dated row count from its date; without any dated row all stay null.
    """
    dated = F.col("cam_ts").isNotNull()
    timed = ~dated & F.col("minute").isNotNull()
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    of_day = F.when(dated, F.hour("cam_ts") * 60 + F.minute("cam_ts")).otherwise(F.col("minute"))
    wrap = timed & (F.col("__of_day") < F.last("__of_day", ignorenulls=True).over(before) - settings.wrap_minutes)
    in_segment = Window.partitionBy("tape_id", "__segment")
    first = F.first(F.when(dated, F.col("cam_ts")), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = (
        samples.withColumn("__of_day", of_day)
        .withColumn("__wrap", F.coalesce(wrap, F.lit(False)).cast("int"))
        .withColumn("__first", first)
        .withColumn("__segment", F.count(F.when(dated, 1)).over(by_time()))
        .withColumn("__anchor", F.coalesce(F.max("cam_ts").over(in_segment), F.col("__first")))
        .withColumn("__wraps", F.sum("__wrap").over(in_segment.orderBy("video_t", "cam_ts")))
    )
    filled = F.date_add(F.to_date("__anchor"), F.col("__wraps").cast("int")).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minute"))
    return marked.withColumn("cam_ts", F.when(timed, filled).otherwise(F.col("cam_ts"))).drop("__of_day", "__wrap", "__first", "__segment", "__anchor", "__wraps")


def calibration_yield(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, n, hits, share): texts of sampled frames (tape_id, raw) that have a date or a time."""
    hit = F.col("cam_ts").isNotNull() | F.col("minute").isNotNull()
    return parsed(readings, settings).groupBy("tape_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("share", F.col("hits") / F.greatest(F.lit(1), F.col("n")))


def calibrate(tapes: DataFrame, read: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, crop, n, hits, share, probed) of tapes (tape_id, duration_s, width, height): the crop of each tape's clock, and how well sampled frames are read with it.

    The crop follows from the frame's size, whatever the yield; a tape whose size is unknown gets the default crop
    without a yield. read answers requests (tape_id, t, crop) with raw, null where no frame could be had: those don't count.
    """
    probed = F.col("width").isNotNull() & F.col("height").isNotNull()
    crops = tapes.select("tape_id", "duration_s", probed.alias("probed"), F.when(probed, bottom_band(F.col("width"), F.col("height"))).otherwise(settings.crop).alias("crop"))
    asked = calibration_times(crops.where("probed").select("tape_id", "duration_s"), settings).join(crops.select("tape_id", "crop"), "tape_id")
    found = calibration_yield(read(asked.select("tape_id", "t", "crop")).where("raw IS NOT NULL").select("tape_id", "raw"), settings)
    out = crops.join(found, "tape_id", "left")
    none = lambda c, zero: F.when(F.col("probed"), F.coalesce(c, F.lit(zero))).alias(c)
    return out.select("tape_id", "crop", none("n", 0), none("hits", 0), none("share", 0.0), "probed")


def calibration_times(tapes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, k, t): evenly spaced interior positions of tapes (tape_id, duration_s)."""
    n = settings.calibration_samples
    return tapes.select("tape_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"), "duration_s").select("tape_id", "k", (F.col("duration_s") / (n + 1) * F.col("k")).alias("t"))


def counts(samples: DataFrame) -> DataFrame:
    """(tape_id, n, n_dated, first_date, last_date): the dates are those of the first and last dated position."""
    at = F.when(F.col("cam_ts").isNotNull(), F.col("video_t"))
    day = F.to_date("cam_ts")
    return samples.groupBy("tape_id").agg(F.count("*").alias("n"), F.count("cam_ts").alias("n_dated"), F.min_by(day, at).alias("first_date"), F.max_by(day, at).alias("last_date"))
