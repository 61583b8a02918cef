"""Key frames, and the plan of the pieces that a clip is cut from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.operators.joins import asof


def packets(lines: DataFrame) -> DataFrame:
    """(tape_id, pts, flags) of lines (tape_id, line) `packet,pts,flags`; lines without a number are dropped."""
    parts = F.split("line", ",")
    return lines.where(F.size(parts) >= 3).select("tape_id", F.get(parts, F.lit(1)).try_cast("double").alias("pts"), F.trim(F.element_at(parts, -1)).alias("flags")).where("pts IS NOT NULL")


def key_frames(of: DataFrame) -> DataFrame:
    return of.where(F.col("flags").contains("K")).select("tape_id", "pts")


def key_before(points: DataFrame, of: DataFrame, at: str, name: str, settings: Settings = DEFAULTS) -> DataFrame:
    """points with `name`: the last key frame at or before `at`, no more than look_back before it; else that limit, 0 at least."""
    limit = F.greatest(F.lit(0.0), F.col(at) - settings.look_back)
    out = asof(points, key_frames(of), at, "pts", "__key")
    return out.withColumn(name, F.greatest(F.col("__key.pts"), limit)).withColumn(name, F.when(F.col(at).isNotNull(), F.col(name))).drop("__key")


def key_after(points: DataFrame, of: DataFrame, at: str, name: str, settings: Settings = DEFAULTS) -> DataFrame:
    """points with `name`: the first key frame at or after `at`, no more than look_ahead after it; else `at` itself."""
    out = asof(points, key_frames(of), at, "pts", "__key", forward=True)
    return out.withColumn(name, F.when(F.col("__key.pts") <= F.col(at) + settings.look_ahead, F.col("__key.pts")).otherwise(F.col(at))).drop("__key")


def segments(clips: DataFrame, of: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, clip_no, seg_no, seg_kind, seg_start, seg_end, action) of clips (…, start_t, end_t, exact_start, exact_end[, lead_video, trail_video]).

    The pieces before the first and behind the last key frame are encoded anew, if they are long enough and have
    video (null counts as yes); the body between is copied; a clip without any piece is copied whole.
    """
    for c in ("lead_video", "trail_video"):
        if c not in clips.columns:
            clips = clips.withColumn(c, F.lit(None).cast("boolean"))
    out = key_before(key_after(clips, of, "exact_start", "__after", settings), of, "exact_end", "__before", settings)
    body = F.coalesce("__after", "start_t"), F.coalesce("__before", "end_t")
    video = {k: F.coalesce(f"{k}_video", F.lit(True)) for k in ("lead", "trail")}
    piece = lambda no, kind, a, b, action: F.struct(F.lit(no).alias("seg_no"), F.lit(kind).alias("seg_kind"), F.col(a).alias("seg_start") if isinstance(a, str) else a.alias("seg_start"), F.col(b).alias("seg_end") if isinstance(b, str) else b.alias("seg_end"), F.lit(action).alias("action"))
    pieces = F.array_compact(
        F.array(
            F.when((F.col("__after") - F.col("exact_start") >= settings.least_segment) & video["lead"], piece(0, "lead", "exact_start", "__after", "encode")),
            F.when(body[1] > body[0], piece(1, "body", *body, "copy")),
            F.when((F.col("exact_end") - F.col("__before") >= settings.least_segment) & video["trail"], piece(2, "trail", "__before", "exact_end", "encode")),
        )
    )
    whole = F.array(piece(1, "whole", "start_t", "end_t", "copy"))
    return out.select("tape_id", "clip_no", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(whole)).alias("p")).select("tape_id", "clip_no", "p.*")
