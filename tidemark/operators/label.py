"""Clips: bounds, numbers, labels and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import values
from tidemark.operators.joins import asof
from tidemark.operators.sample import by_time


def confirmed(filtered: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """filtered with a boolean column confirmed: false for a reading that jumps in and out while its neighbours agree.

    The last reading is confirmed; the first is unless the clock goes back right after it.
    """
    t, c = F.col("video_t"), F.col("cam_ts")
    side = filtered
    for name, move in (("p", F.lag), ("n", F.lead)):
        side = side.withColumns({f"__t{name}": move("video_t").over(by_time()), f"__c{name}": move("cam_ts").over(by_time())})
    before, after = (F.col("__tp"), F.col("__cp")), (F.col("__tn"), F.col("__cn"))
    out = values.jumped(t, c, *after, settings)
    misread = values.jumped(*before, t, c, settings) & ~values.jumped(*before, *after, settings)
    ok = F.when(F.col("__tn").isNull() | ~out, True).when(F.col("__tp").isNull(), values.seconds(c, F.col("__cn")) >= settings.backward).otherwise(~misread)
    return side.withColumn("confirmed", ok).drop("__tp", "__cp", "__tn", "__cn")


def clip_bounds(cuts: DataFrame, tapes: DataFrame) -> DataFrame:
    """(tape_id, clip_no, start_t, end_t, exact_start, exact_end, boundary_id) of cuts and tapes (tape_id, duration_s)."""
    order = Window.partitionBy("tape_id").orderBy("cut_t")
    following = F.lead("cut_t").over(order)
    numbered = cuts.repartition("tape_id").withColumn("clip_no", F.row_number().over(order)).withColumn("exact_end", following)
    joined = numbered.join(tapes.select("tape_id", "duration_s"), "tape_id")
    return joined.select("tape_id", "clip_no", F.col("cut_t").alias("start_t"), F.coalesce("exact_end", "duration_s").alias("end_t"), F.when(F.col("clip_no") > 1, F.col("cut_t")).alias("exact_start"), "exact_end", "boundary_id")


def labelled(clips: DataFrame, filtered: DataFrame, found: DataFrame, mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    """clips with a label: the first confirmed reading from the clip's start whose date isn't that before its boundary.

    Without one, the first reading; without any, the position. Each confirmed reading carries the next one of another
    date, so one as-of join finds either. Boundaries are nearly as many as readings and compress well: they are not broadcast.
    """
    old = clips.join(found.select("tape_id", "boundary_id", F.to_date("cam_before").alias("__old")).hint("merge"), ["tape_id", "boundary_id"], "left")
    return named(old, confirmed(filtered, settings).where("confirmed"), filtered, mode)


def named(clips: DataFrame, sure: DataFrame, filtered: DataFrame, mode: str) -> DataFrame:
    """clips with a label, of confirmed and all readings, and __old, the date before each clip's boundary."""
    back = Window.partitionBy("tape_id").orderBy(F.desc("video_t"), F.desc("cam_ts"))
    sure = sure.withColumn("__d", F.to_date("cam_ts"))
    following = F.lag("__d").over(back)
    changed = F.when(F.col("__d") != following, F.lag("cam_ts").over(back))
    sure = sure.withColumn("__c", changed).withColumn("other", F.last("__c", ignorenulls=True).over(back))
    out = asof(clips, sure.select("tape_id", "video_t", "cam_ts", "other"), "start_t", "video_t", "__sure", forward=True)
    out = asof(out, filtered.select("tape_id", "video_t", "cam_ts"), "start_t", "video_t", "__any", forward=True)
    first = F.col("__sure.cam_ts")
    picked = F.when(F.to_date(first) == F.col("__old"), F.col("__sure.other")).otherwise(first)
    return out.withColumn("label", values.label(F.coalesce(picked, F.col("__any.cam_ts")), F.col("start_t"), mode)).drop("__old", "__sure", "__any")


def file_name(clips: DataFrame, stem: str = "tape_id") -> DataFrame:
    return clips.withColumn("file_name", F.format_string("%s_clip%02d_%s.mp4", stem, "clip_no", "label"))


def same_date_neighbours(clips: DataFrame) -> DataFrame:
    """(tape_id, clip_no, label, previous_s, duration_s) of clips whose label is that of the clip before."""
    order = Window.partitionBy("tape_id").orderBy("clip_no")
    length = F.col("end_t") - F.col("start_t")
    out = clips.withColumn("duration_s", length).withColumn("previous_s", F.lag(length).over(order)).withColumn("__p", F.lag("label").over(order))
    return out.where(F.col("__p") == F.col("label")).select("tape_id", "clip_no", "label", "previous_s", "duration_s")
