"""Whole runs over many tapes: from samples to labelled clips, with or without refinement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.operators import clean, label, refine, sample, segment, tiles
from tidemark.sources.shared import written


@dataclass(frozen=True)
class Result:
    """The tables of a run."""

    filtered: DataFrame
    boundaries: DataFrame
    clips: DataFrame
    refined: DataFrame | None = None


def _cleaned(samples: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Clean readings and their boundaries; both are read several times, so the readings are a written table."""
    filled = sample.fill_time_only(sample.parsed(samples.select("tape_id", "video_t", "raw"), settings), settings)
    filtered = written(clean.clean(filled, settings).select("tape_id", "video_t", "cam_ts"), "filtered")
    return filtered, segment.boundaries(filtered, settings)


def dry_run(samples: DataFrame, tapes: DataFrame, settings: Settings = DEFAULTS) -> Result:
    """samples (tape_id, video_t, raw) and tapes (tape_id, duration_s) to clips at coarse cuts; tapes of long_tape_s or more are worked on in tiles."""
    is_long = F.coalesce(F.col("duration_s") >= settings.long_tape_s, F.lit(False))
    long = tapes.where(is_long)
    if long.isEmpty():
        return _dry_run(samples, tapes, settings)
    # The table of tapes is small beside that of samples; written, so that the planner knows it.
    long, short = written(long, "long-tapes"), written(tapes.where(~is_long), "short-tapes")
    whole = _dry_run(samples.join(long.select("tape_id"), "tape_id", "left_anti"), short, settings)
    tiled = tiles.dry_run(samples.join(long.select("tape_id"), "tape_id", "left_semi"), long, settings)
    return Result(*[a.unionByName(b) for a, b in zip((whole.filtered, whole.boundaries, whole.clips), tiled)])


def _dry_run(samples: DataFrame, tapes: DataFrame, settings: Settings) -> Result:
    filtered, found = _cleaned(samples, settings)
    cuts = segment.merge_short(segment.group_cuts(found, tapes, settings.mode), settings.clip_floor())
    return Result(filtered, found, label.labelled(label.clip_bounds(cuts, tapes), filtered, found, settings.mode, settings))


def run(samples: DataFrame, tapes: DataFrame, read: refine.Reader, events: DataFrame | None = None, scene_cuts: DataFrame | None = None, fuse: bool = False, settings: Settings = DEFAULTS) -> Result:
    """The same with refined cuts: fused with events if asked for, snapped to scene_cuts if given, without garbled orphans."""
    filtered, found = _cleaned(samples, settings)
    if fuse and events is not None:
        found = segment.fuse(found, events, settings)
    chosen = segment.chosen(found, settings.mode)
    refined = refine.refine(chosen, read, events, settings)
    if scene_cuts is not None:
        refined = refine.snap(refined.join(chosen.select("tape_id", "boundary_id", "prev_t"), ["tape_id", "boundary_id"]), scene_cuts, settings)
        moved = F.col("snap_offset") != 0
        refined = refined.withColumn("cut_t", F.when(moved, F.col("snapped_t")).otherwise(F.col("cut_t"))).withColumn("method", F.when(moved, "snap").otherwise(F.col("method"))).select("tape_id", "boundary_id", "cut_t", "method", "detail")
    refined = written(refined, "refined")
    marked = refined.select("tape_id", "boundary_id", "cut_t", (F.col("detail") == "garbled-boundary").alias("garbled"))
    kept = segment.suppress_listed_orphans(marked, settings).select("tape_id", "cut_t", "boundary_id")
    starts = tapes.select("tape_id", F.lit(0.0).alias("cut_t"), F.lit(None).cast("bigint").alias("boundary_id"))
    cuts = segment.merge_short(starts.unionByName(kept), settings.clip_floor())
    # Of boundaries refined to one position the last stands for it.
    last = refined.groupBy("tape_id", "cut_t").agg(F.max("boundary_id").alias("boundary_id"))
    cuts = cuts.select("tape_id", "cut_t").join(last, ["tape_id", "cut_t"], "left")
    return Result(filtered, found, label.labelled(label.clip_bounds(cuts, tapes), filtered, found, settings.mode, settings), refined)
