"""How far cuts are from the changes that readings show.

Zones and readings grow with the tapes, while their tables are a few bytes a row on disk, from which the planner takes
them for small: joins of them are hinted, so that none is gathered in the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import parse
from tidemark.operators.joins import asof
from tidemark.operators.sample import by_time
from tidemark.sources.shared import written


def dead_zones(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, coarse_t, prev_t, none_start, none_span_s, old_dt, new_dt): short unreadable runs between two dates, of samples (tape_id, video_t, raw)."""
    dated = samples.select("tape_id", "video_t", parse.eval_date(F.col("raw"), settings).alias("dt")).withColumn("next_t", F.lead("video_t").over(by_time("dt"))).where("dt IS NOT NULL")
    dated = dated.withColumns({n: F.lag(c).over(by_time("dt")) for n, c in (("prev_t", "video_t"), ("old_dt", "dt"), ("none_start", "next_t"))})
    span = F.col("video_t") - F.col("none_start")
    kept = dated.where((F.col("none_start") < F.col("video_t")) & (F.to_date("old_dt") != F.to_date("dt")) & (span < settings.dead_zone))
    return kept.select("tape_id", F.col("video_t").alias("coarse_t"), "prev_t", "none_start", span.alias("none_span_s"), "old_dt", F.col("dt").alias("new_dt"))


def clip_starts(clips: DataFrame) -> DataFrame:
    """clips (tape_id, clip_no, name, duration_s) with start_t: the lengths of the clips before."""
    before = Window.partitionBy("tape_id").orderBy("clip_no").rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("start_t", F.coalesce(F.sum("duration_s").over(before), F.lit(0.0)))


def nearest_group(zones: DataFrame, groups: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """zones with coarse: the group (tape_id, coarse) of readings nearest to coarse_t, the smaller on ties, if it is near enough."""
    keys = groups.select("tape_id", "coarse").distinct()
    out = asof(asof(zones, keys, "coarse_t", "coarse", "__b"), keys, "coarse_t", "coarse", "__a", forward=True)
    b, a, t = F.col("__b.coarse"), F.col("__a.coarse"), F.col("coarse_t")
    best = F.when(b.isNull() | (a - t < t - b), a).otherwise(b)
    return out.withColumn("coarse", F.when(F.abs(best - t) <= settings.eval_group_distance, best)).drop("__a", "__b")


def true_changes(zones: DataFrame, readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """zones with true_change: the first reading (tape_id, coarse, t, dt) of their group that has another date than the old one."""
    near = nearest_group(zones, readings, settings)
    new = near.join(readings.hint("merge"), ["tape_id", "coarse"]).where(F.to_date("dt") != F.to_date("old_dt"))
    first = new.groupBy("tape_id", "coarse_t").agg(F.min("t").cast("double").alias("true_change"))
    return near.join(first.hint("merge"), ["tape_id", "coarse_t"], "left")


def nearest_cuts(zones: DataFrame, clips: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """zones with pipeline_cut: the start of the nearest clip named by the new date, the earlier clip on ties, closer than eval_cut_distance.

    Clips join by their date, of which the name has one.
    """
    dated = clips.select("tape_id", "clip_no", "start_t", F.regexp_extract("name", r"\d{4}-\d{2}-\d{2}", 0).alias("__date"))
    with_date = zones.withColumn("__date", F.date_format("new_dt", "yyyy-MM-dd"))
    away = F.abs(F.col("start_t") - F.col("coarse_t"))
    near = with_date.join(dated.hint("merge"), ["tape_id", "__date"]).where(away < settings.eval_cut_distance)
    best = near.groupBy("tape_id", "coarse_t").agg(F.min_by("start_t", F.struct(away, F.col("clip_no"))).alias("pipeline_cut"))
    return zones.join(best.hint("merge"), ["tape_id", "coarse_t"], "left")


def results(zones: DataFrame, clips: DataFrame, readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, boundary_idx, coarse_t, none_span_s, old_dt, new_dt, true_change, pipeline_cut, placement_error_s, coarse_error_s); boundary_idx counts a tape's zones from 1; those without a true change are skipped."""
    numbered = zones.withColumn("boundary_idx", F.row_number().over(Window.partitionBy("tape_id").orderBy("coarse_t")))
    out = nearest_cuts(true_changes(numbered, readings, settings), clips, settings).where("true_change IS NOT NULL")

    def error(of: str) -> Column:
        return F.abs(F.col(of) - F.col("true_change"))

    return out.select("tape_id", "boundary_idx", "coarse_t", "none_span_s", "old_dt", "new_dt", "true_change", "pipeline_cut", error("pipeline_cut").alias("placement_error_s"), error("coarse_t").alias("coarse_error_s"))


Labeller = Callable[[DataFrame], DataFrame]


def labels_of(labels: DataFrame) -> Labeller:
    """A labeller of a table (tape_id, t, label) with a row for each whole second that has a frame: requests get the label of the second they are in."""

    def read(requests: DataFrame) -> DataFrame:
        return requests.withColumn("__s", F.floor("t")).join(labels.select("tape_id", F.col("t").cast("bigint").alias("__s"), "label"), ["tape_id", "__s"], "left").drop("__s")

    return read


def bisected(zones: DataFrame, read: Labeller, narrow: float = 2.0) -> DataFrame:
    """zones (tape_id, boundary_id, lo, hi, old, …) with true_change, the position where labels stop to be old, and calls.

    All zones are halved together: a round asks read for one table (tape_id, boundary_id, t) of middles and gets a label
    for each, null where there is no frame. A label that is neither NOISE nor NONE nor old is on the new side. Rounds
    go on, over written tables, until every zone is `narrow` seconds or less; then its seconds are looked at in order,
    and the first new one, else the upper end, is the change. calls counts labels that a sequential search would have asked for.
    """
    key = ["tape_id", "boundary_id"]
    new = F.coalesce(~F.col("label").isin("NOISE", "NONE") & (F.col("label") != F.col("old")), F.lit(False))
    asked = F.col("label").isNotNull().cast("bigint")
    state = written(zones.withColumns({"__lo": F.col("lo").cast("double"), "__hi": F.col("hi").cast("double"), "calls": F.lit(0).cast("bigint")}), "bisection")
    wide = F.col("__hi") - F.col("__lo") > narrow
    while not state.where(wide).isEmpty():
        answers = read(state.where(wide).select(*key, ((F.col("__lo") + F.col("__hi")) / 2).alias("t"), "old"))
        found = answers.select(*key, F.col("t").alias("__mid"), new.alias("__new"), asked.alias("__asked"))
        state = state.join(found, key, "left").withColumns({"__lo": F.when(~F.col("__new"), F.col("__mid")).otherwise(F.col("__lo")), "__hi": F.when(F.col("__new"), F.col("__mid")).otherwise(F.col("__hi")), "calls": F.col("calls") + F.coalesce("__asked", F.lit(0))})
        state = written(state.drop("__mid", "__new", "__asked"), "bisection")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("__hi") - F.col("__lo")).cast("int") + 1))
    sweep = read(state.select(*key, F.explode(steps).alias("k"), "__lo", "__hi", "old").withColumn("t", F.col("__lo") + F.col("k")).where("t <= __hi").select(*key, "t", "old"))
    first = sweep.groupBy(*key).agg(F.min(F.when(new, F.col("t"))).alias("__first"), F.collect_list(F.struct("t", asked.alias("n"))).alias("__asked"))
    until = F.filter("__asked", lambda x: F.col("__first").isNull() | (x["t"] <= F.col("__first")))
    counted = first.select(*key, "__first", F.aggregate(until, F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("__more"))
    out = state.join(counted, key, "left")
    return out.withColumns({"true_change": F.coalesce("__first", "__hi"), "calls": F.col("calls") + F.coalesce("__more", F.lit(0))}).drop("__lo", "__hi", "__first", "__more")


def summary(of: DataFrame) -> DataFrame:
    """One row: count, and median, largest and mean of both errors, nulls left out."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("placement_error_s", "coarse_error_s") for n, f in (("median", F.median), ("max", F.max), ("mean", F.avg))]
    return of.agg(F.count("*").alias("n"), *stats)
