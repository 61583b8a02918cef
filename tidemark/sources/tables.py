"""The driver's tables as clock streams: what a tape, a reading, a frame and an event is in them.

A tape is a block of thirty users, so that the number of tapes grows with the data and a tape's length doesn't. Rows
of a tape in the order of time stand ten seconds apart; the clock is that of 34 years before, in minutes, with misreads
at fixed row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

USERS_OF_A_TAPE = 30


def events(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """(tape_id, rn, event_type, ts) of the events table, numbered along each tape; ranged: by ranges of a sorted, written table, where one tape may hold a large part of all rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("user_id") / USERS_OF_A_TAPE).cast("string").alias("tape_id"), "event_id", "event_type", "ts")
    if ranged:
        keys = ["tape_id", "ts", "event_id"]
        e = written(e.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "events")
        e = e.withColumn("part", F.shiftright("at", 33))
        parts = e.groupBy("tape_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("tape_id").orderBy("part")) - F.col("n")
        parts = written(parts.select("tape_id", "part", "low", before.alias("before")), "parts")
        return e.join(parts, ["tape_id", "part"]).select("tape_id", "event_type", "ts", (F.col("at") - F.col("low") + F.col("before") + 1).cast("int").alias("rn"))
    order = Window.partitionBy("tape_id").orderBy("ts", "event_id")
    return e.withColumn("rn", F.row_number().over(order)).drop("event_id")


def _clock_text(year: Column, month: Column, day: Column, hour: Column, minute: Column, timed_only: Column) -> Column:
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    clock = F.concat(twelve.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.when(hour >= 12, " PM").otherwise(" AM"))
    date = F.concat(F.lit(" "), month.cast("string"), F.lit("/ "), day.cast("string"), F.lit("/"), F.lpad((year - 1900).cast("string"), 2, "0"))
    return F.when(timed_only, clock).otherwise(F.concat(clock, date))


def samples(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """(tape_id, rn, video_t, raw, event_type): readings with misreads at fixed row numbers, null where the event is an error, without date where it is a signup."""
    e, rn = events(spark, sf_dir, ranged), F.col("rn")
    y, mo, d, h, mi = F.year("ts") - 34, F.month("ts"), F.day("ts"), F.hour("ts"), F.minute("ts")
    rule = F.when(rn % 53 == 0, "hour").when(rn % 97 == 0, "island").when((rn % 89).isin(0, 1), "digit").when((rn % 83).isin(0, 1), "month").when((rn % 79).isin(0, 1), "year").otherwise("")
    e = e.withColumn("__rule", rule)
    is_ = lambda k: F.col("__rule") == k
    hour = F.when(is_("hour"), (h + 11) % 24).otherwise(h)
    year = F.when(is_("island"), y + 9).when(is_("year"), y + 1).otherwise(y)
    day = F.when(is_("digit") & (d >= 10), d % 10).otherwise(d)
    month = F.when(is_("month") & (mo == 1), 5).otherwise(mo)
    raw = F.when(F.col("event_type") != "error", _clock_text(year, month, day, hour, mi, F.col("event_type") == "signup"))
    return e.select("tape_id", "rn", (rn * 10.0).cast("double").alias("video_t"), raw.alias("raw"), "event_type")


def tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tape_id, duration_s, width, height)."""
    own = events(spark, sf_dir).groupBy("tape_id").agg((F.max("rn") * 10.0 + 10.0).cast("double").alias("duration_s"))
    n = F.col("tape_id").cast("int")
    return own.select("tape_id", "duration_s", (n * 40 + 160).cast("int").alias("width"), (n * 30 + 40).cast("int").alias("height"))


def visual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tape_id, t, kind): a scene cut a little before each click and a black frame before each purchase."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase"))
    return e.select("tape_id", (F.col("rn") * 10.0 - F.when(F.col("event_type") == "click", 2.5).otherwise(4.25)).cast("double").alias("t"), F.when(F.col("event_type") == "click", "scene").otherwise("black").alias("kind"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tape_id, line): the visual events as the media tools log them."""
    t = F.format_string("%.3f", "t")
    return visual_events(spark, sf_dir).select("tape_id", F.when(F.col("kind") == "scene", F.concat(F.lit("[Parsed_showinfo_1] n: 0 pts_time:"), t, F.lit(" pos: 1"))).otherwise(F.concat(F.lit("[blackdetect] black_start:"), t, F.lit(" black_end:9"))).alias("line"))


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tape_id, line): packets every ten seconds, one in three a key frame, some without a number."""
    e, rn = events(spark, sf_dir), F.col("rn")
    pts = F.when(rn % 31 == 0, "N/A").otherwise(F.format_string("%.1f", rn * 10.0 - 4.5))
    return e.select("tape_id", F.concat(F.lit("packet,"), pts, F.when(rn % 3 == 0, ",K_").otherwise(",__")).alias("line"))


def frames(spark: SparkSession, sf_dir: str, preprocess: bool = False) -> DataFrame:
    """(tape_id, frame_idx, path, raw): three frames of a sample, whose texts differ; of the second pass other frames are unreadable."""
    s, rn = samples(spark, sf_dir), F.col("rn")
    out = s.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("frame_idx", ((rn - 1) * 3 + F.col("k")).cast("int"))
    lost = (F.col("frame_idx") % 7 == 0) | ((rn % 5 == 0) & F.lit(not preprocess))
    other = (F.col("frame_idx") % 11 == 0) & F.col("raw").isNotNull()
    raw = F.when(lost, F.lit("")).when(other, F.concat(F.lit("9:07 PM 1/ "), (1 + F.col("frame_idx") % 3).cast("string"), F.lit("/90"))).otherwise(F.coalesce("raw", F.lit("")))
    # The second pass has one frame less of every fourth tape, whose fallback then isn't used.
    kept = ~((F.col("tape_id").cast("int") % 4 == 3) & (F.col("frame_idx") == 0)) if preprocess else F.lit(True)
    return out.where(kept).select("tape_id", "frame_idx", F.format_string("/t/frame_%06d.bmp", "frame_idx").alias("path"), raw.alias("raw"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tape_id, t, raw): a reading each second: that of the row before, some unreadable, some garbled so that only lenient digits survive."""
    s = samples(spark, sf_dir).withColumn("t", F.explode(F.sequence((F.col("rn") * 10).cast("int"), (F.col("rn") * 10 + 9).cast("int"))))
    garbled = F.regexp_replace("raw", "[AP]M ", "#")
    raw = F.when(F.col("t") % 10 >= 6, F.lit("")).when(F.col("t") % 13 == 0, F.regexp_replace(garbled, "/ ", "//")).otherwise(F.coalesce("raw", F.lit("")))
    return s.select("tape_id", "t", F.coalesce(raw, F.lit("")).alias("raw"))
