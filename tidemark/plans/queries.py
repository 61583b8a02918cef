"""The registered queries of the clock-stream operators over the driver's tables."""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions import parse, values
from tidemark.operators import clean, cutplan, evaluate, label, model, refine, sample, segment, tiles
from tidemark.plans import pipeline
from tidemark.sources import caches, recogniser, shared, store, tables
from tidemark.streaming import tapes as streamed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SESSION = dataclasses.replace(DEFAULTS, mode="session")
SCENE = dataclasses.replace(DEFAULTS, mode="scene")


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.parsed(tables.samples(spark, sf_dir).drop("rn", "event_type"))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.fill_time_only(_parsed(spark, sf_dir)).select("tape_id", "video_t", "cam_ts")


def _stages(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Samples after each rule of the cleaner, in its order."""
    out = [_filled(spark, sf_dir)]
    for rule in (clean.drop_date_islands, clean.drop_year_runs, clean.drop_digit_runs, clean.drop_month_runs, clean.drop_outliers):
        out.append(rule(out[-1]))
    return out


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.written(clean.clean(_filled(spark, sf_dir)), "filtered")


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundaries(_filtered(spark, sf_dir))


# --- sources ---


@_query
def src_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tapes(spark, sf_dir)


@_query
def src_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.samples(spark, sf_dir).select("tape_id", "video_t", "raw")


@_query
def src_sample_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples through their JSON cache."""
    path = shared.fresh_path(spark, "samples")
    caches.write_sample_cache(tables.samples(spark, sf_dir).select("tape_id", "video_t", "raw"), path)
    return caches.sample_cache(spark, path)


@_query
def src_visual_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual events through their JSON cache."""
    path = shared.fresh_path(spark, "visual")
    caches.write_visual_cache(tables.visual_events(spark, sf_dir), path)
    return caches.visual_cache(spark, path)


@_query
def visual_cache_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why caches of the visual events, half of the tapes' written with another threshold, can't be used."""
    path, events = shared.fresh_path(spark, "visual"), tables.visual_events(spark, sf_dir)
    odd, settings = F.col("tape_id").cast("int") % 2 == 1, dataclasses.replace(DEFAULTS, scene_threshold=0.3, visual_cache_format=0)
    caches.write_visual_cache(events.where(odd), f"{path}/odd", settings)
    caches.write_visual_cache(events.where(~odd), f"{path}/even")
    reasons = [caches.visual_cache_mismatch(spark, f"{path}/{k}") for k in ("odd", "even")]
    return reasons[0].unionByName(reasons[1]).groupBy("tape_id").agg(F.max(F.array_join("reasons", ",")).alias("reasons"))


@_query
def src_readings_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each second through the JSON map of a tape's readings, whose names have a coarse position and a second."""
    path = shared.fresh_path(spark, "readings")
    r = tables.readings(spark, sf_dir).where("raw <> ''")
    caches.write_readings_map(r.withColumn("coarse", (F.floor(F.col("t") / 100) * 100).cast("int")), path)
    return caches.readings_map(spark, path)


@_query
def src_ocr_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.frames(spark, sf_dir)
    lines = f.select("tape_id", F.when(F.col("frame_idx") % 17 == 0, F.col("path")).otherwise(F.concat("path", F.lit("\t"), "raw", F.when(F.col("frame_idx") % 19 == 0, "\tx").otherwise(""))).alias("line"))
    return caches.wire_lines(lines)


@_query
def src_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutplan.packets(tables.packet_lines(spark, sf_dir))


@_query
def visual_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.visual_log(tables.log_lines(spark, sf_dir))


@_query
def src_clip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stem = F.when(F.col("o_orderkey") % 5 == 0, "/c/a_").otherwise("/c/a_clip")
    return caches.clip_files(o.select("o_orderkey", F.concat(stem, F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("_"), F.col("o_orderdate").cast("date").cast("string"), F.lit(".mp4")).alias("path")))


#: A recogniser for these tables: a path's text is what stands behind its first bar.
ECHO = [sys.executable, "-u", "-c", "import sys\nfor line in sys.stdin:\n    print(line.rstrip('\\n') + '\\t' + line.rstrip('\\n').partition('|')[2])"]


@_query
def src_ocr_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of frames through an external program, a process for each task."""
    f = tables.frames(spark, sf_dir)
    return recogniser.recognised(f.select("tape_id", "frame_idx", F.concat("path", F.lit("|"), "raw").alias("path")), ECHO).select("tape_id", "frame_idx", "raw")


@_query
def store_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples through a store: half of the tapes are scanned in a first run, the others in a second one."""
    path, tapes = shared.fresh_path(spark, "store"), tables.tapes(spark, sf_dir)
    scan = lambda wanted: tables.samples(spark, sf_dir).join(wanted.select("tape_id"), "tape_id", "left_semi")
    store.scanned(tapes.where(F.col("tape_id").cast("int") % 2 == 0), path, scan)
    return store.scanned(tapes, path, scan)


@_query
def sink_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily clips written over scene clips of every third tape and of none else."""
    path, third = shared.fresh_path(spark, "clips"), F.col("tape_id").cast("int") % 3 == 0
    tapes = tables.tapes(spark, sf_dir)
    daily = shared.written(_clips(spark, sf_dir, DEFAULTS).select("tape_id", "clip_no", "start_t", "label"), "daily-clips")
    scene = label.clip_bounds(_cuts(spark, sf_dir, "scene"), tapes).select("tape_id", "clip_no", "start_t", F.lit("old").alias("label"))
    store.write_by_tape(scene.where(third), path, tapes.where(third))
    store.write_by_tape(daily.where(~third), path, tapes.where(~third))
    store.write_by_tape(daily.where(third), path, tapes.where(third))
    return store.by_tape(spark, path, "clip_no").select("tape_id", "clip_no", "start_t", "label")


# --- functions ---


@_query
def fn_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of readings, and of the same readings with line ends, word months and seconds."""
    s = tables.samples(spark, sf_dir).where("raw IS NOT NULL").select("tape_id", "video_t", F.col("raw").alias("a"))
    word = F.regexp_replace("a", r"M 1/ (\d+)/(\d+)", "M Jan. $1  $2")
    odd = F.regexp_replace(F.regexp_replace("a", " ", " \n "), r":(\d\d) ?", ":$1:59 ")
    for name, text in (("plain", F.col("a")), ("word", word), ("odd", odd)):
        s = parse.with_reading(s.withColumn("__raw", text), "__raw", cam_ts=name, minute=None)
    return s.select("tape_id", "video_t", "plain", "word", "odd")


@_query
def fn_parse_time_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("tape_id", "video_t", "minute")


@_query
def fn_parse_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.samples(spark, sf_dir).select("tape_id", "video_t", parse.eval_date(F.col("raw")).alias("dt"))


@_query
def fn_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.frames(spark, sf_dir)
    return f.select("tape_id", "path", parse.frame_index(F.col("path")).alias("frame_idx"), sample.bucket(parse.frame_index(F.col("path"))).alias("bucket"))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings garbled in three ways, between the dates around them."""
    p = _parsed(spark, sf_dir).where("cam_ts IS NOT NULL")
    k = (F.col("video_t") / 10).cast("int") % 3
    raw = F.when(k == 0, F.regexp_replace("raw", "/ ", "//")).when(k == 1, F.regexp_replace("raw", "/", "4/")).otherwise(F.regexp_replace("raw", r"\d+/ ", ""))
    return p.select("tape_id", "video_t", raw.alias("garbled"), F.lag("cam_ts", 5).over(sample.by_time()).alias("old_ts"), F.lead("cam_ts", 5).over(sample.by_time()).alias("new_ts")).where("old_ts IS NOT NULL AND new_ts IS NOT NULL")


@_query
def fn_lenient_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _garbled(spark, sf_dir)
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return g.select("tape_id", "video_t", "garbled", text(parse.lenient_days(F.col("garbled"))).alias("days"), text(parse.lenient_months(F.col("garbled"))).alias("months"))


@_query
def fn_gap_date_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("tape_id", "video_t", parse.gap_class(F.col("garbled"), F.col("old_ts"), F.col("new_ts")).alias("cls"))


@_query
def fn_drift_jumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir).where("cam_ts IS NOT NULL").withColumns({"pt": F.lag("video_t").over(sample.by_time()), "pc": F.lag("cam_ts").over(sample.by_time())}).where("pt IS NOT NULL")
    args = F.col("pt"), F.col("pc"), F.col("video_t"), F.col("cam_ts")
    return p.select("tape_id", "video_t", values.drift(*args).alias("drift"), values.jumped(*args).alias("jumped"), values.confusable_months(F.month("pc"), F.month("cam_ts")).alias("confusable"))


@_query
def fn_bottom_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tapes(spark, sf_dir).select("tape_id", values.bottom_band(F.col("width"), F.col("height")).alias("crop"))


# --- samples ---


@_query
def vote_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.vote(tables.frames(spark, sf_dir))


@_query
def vote_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.two_phase(tables.frames(spark, sf_dir), tables.frames(spark, sf_dir, preprocess=True))


@_query
def fill_time_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


@_query
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.counts(_filled(spark, sf_dir))


@_query
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.calibration_yield(tables.samples(spark, sf_dir).where("raw IS NOT NULL"))


@_query
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops and yields of all tapes, two in seven of which can't be probed; frames are the readings of the samples' seconds."""
    size = lambda c: F.when(F.col("tape_id").cast("int") % 7 > 1, F.col(c)).alias(c)
    tapes = tables.tapes(spark, sf_dir).select("tape_id", "duration_s", size("width"), size("height"))
    frames = tables.readings(spark, sf_dir).select("tape_id", F.col("t").alias("__s"), "raw")
    read = lambda asked: asked.withColumn("__s", F.floor("t").cast("int")).join(frames, ["tape_id", "__s"], "left")
    return sample.calibrate(tapes, read)


@_query
def calibration_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.calibration_times(tables.tapes(spark, sf_dir))


# --- cleaning ---


@_query
def drop_date_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir)[1]


@_query
def drop_year_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir)[2]


@_query
def drop_digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir)[3]


@_query
def drop_month_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir)[4]


@_query
def drop_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir)[5]


# --- segments ---


@_query
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boundaries(spark, sf_dir)


@_query
def fuse_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.fuse(_boundaries(spark, sf_dir), tables.visual_events(spark, sf_dir)).select("tape_id", "boundary_id", "video_t")


def _cuts(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return segment.group_cuts(_boundaries(spark, sf_dir), tables.tapes(spark, sf_dir), mode)


@_query
def group_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir, "scene")


@_query
def group_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir, "session")


@_query
def group_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir, "daily")


@_query
def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.merge_short(_cuts(spark, sf_dir, "scene"), DEFAULTS.min_clip)


@_query
def suppress_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _cuts(spark, sf_dir, "scene").withColumn("garbled", (F.col("cut_t") / 10).cast("int") % 3 != 0)
    return segment.suppress_orphans(marked).select("tape_id", "cut_t")


@_query
def reading_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.confirmed(_filtered(spark, sf_dir)).select("tape_id", "video_t", "confirmed")


def _clips(spark: SparkSession, sf_dir: str, settings) -> DataFrame:
    return pipeline.dry_run(tables.samples(spark, sf_dir).select("tape_id", "video_t", "raw"), tables.tapes(spark, sf_dir), settings).clips


@_query
def clips_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.file_name(_clips(spark, sf_dir, DEFAULTS))


@_query
def clips_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.file_name(_clips(spark, sf_dir, SESSION))


@_query
def clips_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.file_name(_clips(spark, sf_dir, SCENE))


@_query
def clips_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily clips of tapes in tiles of an hour, numbered and cut without any task that has a whole tape."""
    settings = dataclasses.replace(DEFAULTS, tile_s=3600.0)
    s = shared.written(tables.samples(spark, sf_dir, ranged=True), "samples")
    tapes = shared.written(s.groupBy("tape_id").agg((F.max("video_t") + 10.0).alias("duration_s")), "tapes")
    return label.file_name(tiles.dry_run(s, tapes, settings)[2])


@_query
def merge_short_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene cuts merged by a walk along pointers, in blocks of 256 cuts."""
    settings = dataclasses.replace(DEFAULTS, tile_s=3600.0)
    return tiles.merge_short(shared.written(_cuts(spark, sf_dir, "scene"), "scene-cuts"), DEFAULTS.min_clip, settings, block=256)


@_query
def same_date_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered, tapes = _filtered(spark, sf_dir), tables.tapes(spark, sf_dir)
    found = segment.boundaries(filtered)
    return label.same_date_neighbours(label.labelled(label.clip_bounds(segment.group_cuts(found, tapes, "session"), tapes), filtered, found, "daily"))


# --- refinement ---


@_query
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = refine.windowed(segment.chosen(_boundaries(spark, sf_dir), "session"))
    own = refine.judged(refine.reader_of(tables.readings(spark, sf_dir))(refine.dense_requests(windows)))
    return refine.transition(own)


@_query
def refine_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = segment.chosen(_boundaries(spark, sf_dir), "session")
    return refine.refine(chosen, refine.reader_of(tables.readings(spark, sf_dir)), tables.visual_events(spark, sf_dir).select("tape_id", "t"))


def _with_dead_zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples of which 26 in a row are unreadable again and again, and readings of each second, of which one stretch in three has none."""
    rn = F.col("rn")
    s = tables.samples(spark, sf_dir).withColumn("raw", F.when(~(rn % 211).between(60, 85), F.col("raw"))).select("tape_id", "video_t", "raw")
    r = tables.readings(spark, sf_dir).withColumn("raw", F.when(F.floor(F.col("t") / 2110) % 3 == 0, "").otherwise(F.col("raw")))
    return s, r


@_query
def refine_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries across dead zones of minutes: a coarse pass, and a dense one where it asks for it."""
    s, r = _with_dead_zones(spark, sf_dir)
    filled = sample.fill_time_only(sample.parsed(s)).select("tape_id", "video_t", "cam_ts")
    found = segment.boundaries(shared.written(clean.clean(filled), "filtered"))
    return refine.refine(segment.chosen(found, "session"), refine.reader_of(r), tables.visual_events(spark, sf_dir).select("tape_id", "t"))


@_query
def scene_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _boundaries(spark, sf_dir).select("tape_id", "boundary_id", F.col("video_t").alias("cut_t"), "prev_t")
    scenes = tables.visual_events(spark, sf_dir).withColumn("t", F.when(F.col("kind") == "black", F.col("t") + 4.0).otherwise(F.col("t"))).select("tape_id", "t")
    return refine.snap(cuts, scenes)


@_query
def clips_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run in daily mode: fused, refined, snapped, without orphans and artifacts, labelled."""
    s = tables.samples(spark, sf_dir).select("tape_id", "video_t", "raw")
    events = tables.visual_events(spark, sf_dir).select("tape_id", "t")
    return pipeline.run(s, tables.tapes(spark, sf_dir), refine.reader_of(tables.readings(spark, sf_dir)), events, events, fuse=True).clips


# --- cut plan ---


@_query
def keyframe_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _cuts(spark, sf_dir, "session").select("tape_id", "cut_t")
    return cutplan.key_before(cuts, cutplan.packets(tables.packet_lines(spark, sf_dir)), "cut_t", "key_t")


@_query
def keyframe_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _cuts(spark, sf_dir, "session").select("tape_id", "cut_t")
    return cutplan.key_after(cuts, cutplan.packets(tables.packet_lines(spark, sf_dir)), "cut_t", "key_t")


@_query
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = label.clip_bounds(_cuts(spark, sf_dir, "session"), tables.tapes(spark, sf_dir)).withColumn("lead_video", F.col("clip_no") % 5 != 0)
    return cutplan.segments(clips, cutplan.packets(tables.packet_lines(spark, sf_dir)))


# --- evaluator ---


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dead_zones(tables.samples(spark, sf_dir).select("tape_id", "video_t", "raw"))


def _eval_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily clips as files of a length each."""
    c = label.file_name(_clips(spark, sf_dir, DEFAULTS))
    return evaluate.clip_starts(c.select("tape_id", "clip_no", F.col("file_name").alias("name"), (F.col("end_t") - F.col("start_t")).alias("duration_s")))


def _eval_readings(spark: SparkSession, sf_dir: str, zones: DataFrame) -> DataFrame:
    """Readings around each zone, as if sampled: each second of the ten before and five behind it, its key off by up to two seconds.

    Requests are sixteen times the zones, of which the planner knows the file only, so the join is hinted; its result is read twice.
    """
    c = F.col("coarse_t").cast("int")
    t = zones.select("tape_id", (c + c % 3).alias("coarse"), F.explode(F.sequence(c - 10, c + 5)).alias("t"))
    r = tables.readings(spark, sf_dir).select("tape_id", "t", parse.eval_date(F.col("raw")).alias("dt"))
    return shared.written(t.hint("merge").join(r, ["tape_id", "t"]), "dense")


@_query
def dead_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zones(spark, sf_dir)


@_query
def clip_start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval_clips(spark, sf_dir)


@_query
def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = shared.written(_zones(spark, sf_dir), "zones")
    return evaluate.results(zones, _eval_clips(spark, sf_dir), _eval_readings(spark, sf_dir, zones))


@_query
def find_true_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of date around each dead zone by bisection, all zones at once; labels are the dates that readings show."""
    zones = shared.written(_zones(spark, sf_dir), "zones")
    date = lambda c: F.to_date(c).cast("string")
    t = F.col("coarse_t")
    own = zones.select("tape_id", t.cast("bigint").alias("boundary_id"), "coarse_t", F.greatest(F.lit(0.0), t - DEFAULTS.search_before).alias("lo"), (t + DEFAULTS.search_behind).alias("hi"), date("old_dt").alias("old"))
    labels = tables.readings(spark, sf_dir).select("tape_id", "t", F.coalesce(date(parse.eval_date(F.col("raw"))), F.when(F.col("raw") == "", "NONE").otherwise("NOISE")).alias("label"))
    return evaluate.bisected(own, evaluate.labels_of(labels)).select("tape_id", "coarse_t", "true_change", "calls")


# --- clock models ---


def _modelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    filtered = _filtered(spark, sf_dir)
    found = segment.chosen(segment.boundaries(filtered), "session")
    readings = shared.written(model.segmented(filtered, found), "segmented")
    return readings, shared.written(model.models(readings), "models")


@_query
def segment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(spark, sf_dir)[1]


@_query
def model_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.drop_misfits(*_modelled(spark, sf_dir))


@_query
def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.predictions(tables.samples(spark, sf_dir), *_modelled(spark, sf_dir))


# --- streams ---


@_query
def stream_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of the samples, streamed: those that islands and outliers leave."""
    path = shared.fresh_path(spark, "stream")
    s, t = tables.samples(spark, sf_dir), tables.tapes(spark, sf_dir).select("tape_id", "duration_s")
    ending = s.join(t, "tape_id").withColumn("duration_s", F.when(F.col("video_t") == F.col("duration_s") - 10.0, F.col("duration_s")))
    ending.select("tape_id", "video_t", "raw", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived"), "duration_s").write.parquet(f"{path}/in")
    stream = sample.parsed(spark.readStream.schema("tape_id STRING, video_t DOUBLE, raw STRING, arrived TIMESTAMP, duration_s DOUBLE").parquet(f"{path}/in"))
    query = streamed.boundaries(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streamed.OUTPUT).parquet(f"{path}/out").where("type <> 'end'")


@_query
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(eval_results(spark, sf_dir))


@_query
def sink_eval_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluator results through their JSON documents: each tape's summary, and how many boundaries its document lists."""
    path = shared.fresh_path(spark, "evaluation")
    caches.write_results(eval_results(spark, sf_dir), path)
    back = spark.read.schema("boundaries ARRAY<STRUCT<boundary_idx: INT, coarse_t: DOUBLE>>, summary STRUCT<count: BIGINT, pipeline_median_error_s: DOUBLE, coarse_median_error_s: DOUBLE>, tape_id STRING").json(path)
    return back.select("tape_id", F.size("boundaries").cast("bigint").alias("listed"), F.element_at("boundaries", 1)["boundary_idx"].alias("first_idx"), F.element_at("boundaries", -1)["coarse_t"].alias("last_t"), "summary.*")
