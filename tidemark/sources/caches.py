"""JSON caches and text logs as DataFrames, and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import parse

_SAMPLES = "cache_format INT, interval INT, crop STRING, vf_preprocess STRING, frames_per_sample INT, samples ARRAY<ARRAY<STRING>>"
_VISUAL = "cache_format INT, scene_threshold DOUBLE, black_min_duration DOUBLE, scene_cuts ARRAY<DOUBLE>, black_frames ARRAY<DOUBLE>"


def _documents(spark: SparkSession, path: str, schema: str, tape_id: str | None, multi_line: bool) -> DataFrame:
    """Cache documents, one to a line or (multi_line) to a file, with their tape: the id given, else that of a folder tape_id=…, else the file's name."""
    docs = spark.read.option("multiLine", multi_line).schema(f"{schema}, tape_id STRING").json(path)
    if tape_id is not None:
        return docs.withColumn("tape_id", F.lit(tape_id))
    named = lambda pattern: F.nullif(F.regexp_extract(F.input_file_name(), pattern, 1), F.lit(""))
    return docs.withColumn("tape_id", F.coalesce("tape_id", named(r"/tape_id=([^/]+)/"), named(r"([^/]+?)(?:_ocr_cache|_visual_cache)?\.json$")))


def sample_cache(spark: SparkSession, path: str, tape_id: str | None = None, vf_preprocess: str | None = None, settings: Settings = DEFAULTS, multi_line: bool = False) -> DataFrame:
    """(tape_id, video_t, raw) of sample caches that were written with these settings; caches of others give no rows.

    Raw text is kept and parsed at each reading, so a better parser needs no new scan.
    """
    docs = _documents(spark, path, _SAMPLES, tape_id, multi_line)
    same = (F.col("cache_format") == settings.cache_format) & (F.col("interval") == settings.interval) & (F.col("crop") == settings.crop) & (F.coalesce("frames_per_sample", F.lit(1)) == settings.frames_per_sample)
    if vf_preprocess is not None:
        same &= F.col("vf_preprocess") == vf_preprocess
    rows = docs.where(same).select("tape_id", F.explode("samples").alias("s"))
    return rows.select("tape_id", F.get("s", F.lit(0)).try_cast("double").alias("video_t"), F.get("s", F.lit(1)).alias("raw"))


def write_sample_cache(samples: DataFrame, path: str, vf_preprocess: str = "", settings: Settings = DEFAULTS, span: float = 36_000.0) -> None:
    """samples (tape_id, video_t, raw) as JSON documents, a folder for each tape; a document has the samples of `span` seconds, so a long tape is many."""
    # A pair is a number and a string, so the array is put together as text.
    pair = F.concat(F.lit("["), F.to_json(F.array("video_t")).substr(F.lit(2), F.length(F.to_json(F.array("video_t"))) - 2), F.lit(","), F.coalesce(F.expr("substr(to_json(array(raw)), 2, length(to_json(array(raw))) - 2)"), F.lit("null")), F.lit("]"))
    head = json.dumps({"cache_format": settings.cache_format, "interval": settings.interval, "crop": settings.crop, "vf_preprocess": vf_preprocess, "frames_per_sample": settings.frames_per_sample})[:-1]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("video_t", pair.alias("p")))), lambda x: x["p"]), ",")
    docs = samples.groupBy("tape_id", F.floor(F.col("video_t") / span)).agg(listed.alias("l")).select("tape_id", F.concat(F.lit(head + ', "samples": ['), "l", F.lit("]}")).alias("value"))
    docs.write.mode("overwrite").partitionBy("tape_id").text(path)


def visual_cache(spark: SparkSession, path: str, tape_id: str | None = None, settings: Settings = DEFAULTS, multi_line: bool = False) -> DataFrame:
    """(tape_id, t, kind) of visual caches that were written with these settings."""
    docs = _documents(spark, path, _VISUAL, tape_id, multi_line)
    same = (F.col("cache_format") == settings.visual_cache_format) & (F.col("scene_threshold") == settings.scene_threshold) & (F.col("black_min_duration") == settings.black_min_duration)

    def of(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<double>")), lambda t: F.struct(t.alias("t"), F.lit(kind).alias("kind")))

    kinds = F.concat(of("scene_cuts", "scene"), of("black_frames", "black"))
    return docs.where(same).select("tape_id", F.explode(kinds).alias("e")).select("tape_id", "e.t", "e.kind")


def visual_cache_mismatch(spark: SparkSession, path: str, tape_id: str | None = None, settings: Settings = DEFAULTS, multi_line: bool = False) -> DataFrame:
    """(tape_id, reasons): which settings of each visual cache document aren't these."""
    docs = _documents(spark, path, _VISUAL, tape_id, multi_line)
    wanted = {"cache_format": settings.visual_cache_format, "scene_threshold": settings.scene_threshold, "black_min_duration": settings.black_min_duration}
    return docs.select("tape_id", F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), k) for k, v in wanted.items()])).alias("reasons"))


def write_visual_cache(events: DataFrame, path: str, settings: Settings = DEFAULTS, span: float = 36_000.0) -> None:
    """events (tape_id, t, kind) as JSON documents, a folder for each tape; a document has the events of `span` seconds."""

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("t"))))

    docs = events.groupBy("tape_id", F.floor(F.col("t") / span)).agg(of("scene").alias("scene_cuts"), of("black").alias("black_frames"))
    head = [F.lit(settings.visual_cache_format).alias("cache_format"), F.lit(settings.scene_threshold).alias("scene_threshold"), F.lit(settings.black_min_duration).alias("black_min_duration")]
    docs.select("tape_id", *head, "scene_cuts", "black_frames").write.mode("overwrite").partitionBy("tape_id").json(path)


def wire_lines(lines: DataFrame) -> DataFrame:
    """(…, path, raw) of lines (…, line) `path<TAB>text`, cut at the first tab; lines without one are dropped."""
    at = F.instr("line", "\t")
    return lines.where(at > 0).withColumns({"path": F.substring("line", F.lit(1), at - 1), "raw": F.substring("line", at + 1, F.length("line"))}).drop("line")


# How the media tools name events in their logs.
_SCENE, _BLACK = r"pts_time:([0-9]+(?:\.[0-9]+)?)", r"black_start:([0-9]+(?:\.[0-9]+)?)"


def visual_log(lines: DataFrame) -> DataFrame:
    """(tape_id, t, kind) of log lines (tape_id, line) of scene filters and black detectors."""
    found = lambda name, pattern: F.when(F.col("line").contains(name), F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast("double"))
    scene, black = found("pts_time:", _SCENE), found("black_start:", _BLACK)
    out = lines.withColumn("e", F.array_compact(F.array(F.when(scene.isNotNull(), F.struct(scene.alias("t"), F.lit("scene").alias("kind"))), F.when(scene.isNull() & black.isNotNull(), F.struct(black.alias("t"), F.lit("black").alias("kind"))))))
    return out.select("tape_id", F.explode("e").alias("e")).select("tape_id", "e.t", "e.kind")


def readings_map(spark: SparkSession, path: str, tape_id: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, coarse, t, dt) of JSON maps, one to a file, from b<coarse>_t<t>.png to text.

    Other names are dropped, of equal ones the last in the file counts. The tape is the id given, else that of a folder tape_id=….
    """
    folder = F.url_decode(F.replace(F.regexp_extract(F.input_file_name(), "/tape_id=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))
    own = spark.read.option("wholetext", True).text(path).select("value", (folder if tape_id is None else F.lit(tape_id)).alias("tape_id"))
    pairs = own.select("tape_id", F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("k", "e"))
    name = F.col("e.key")
    rows = pairs.where(name.rlike(parse.READING_NAME)).select("tape_id", "k", F.regexp_extract(name, parse.READING_NAME, 1).cast("int").alias("coarse"), F.regexp_extract(name, parse.READING_NAME, 2).cast("int").alias("t"), F.col("e.value").alias("raw"))
    last = rows.groupBy("tape_id", "coarse", "t").agg(F.max_by("raw", "k").alias("raw"))
    return last.select("tape_id", "coarse", "t", parse.eval_date(F.col("raw"), settings).alias("dt"))


def write_readings_map(readings: DataFrame, path: str, span: int = 10_000) -> None:
    """readings (tape_id, coarse, t, raw) as JSON maps, each of the coarse positions of `span` seconds of a tape, in a folder of its own."""
    name = F.format_string("b%03d_t%04d.png", "coarse", "t")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("name"), "raw"))))
    maps = readings.groupBy("tape_id", F.floor(F.col("coarse") / span).alias("part")).agg(F.to_json(entries).alias("value"))
    maps.write.mode("overwrite").partitionBy("tape_id", "part").text(path)


def clip_files(files: DataFrame) -> DataFrame:
    """(…, clip_no, name) of files (…, path) named *_clip<number>*.mp4."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(r"_clip\d+.*\.mp4$")).withColumns({"name": name, "clip_no": F.regexp_extract(name, r"_clip(\d+)", 1).cast("int")})


def result_documents(results: DataFrame) -> DataFrame:
    """(tape_id, boundaries, summary) of evaluator results: a tape's boundaries in order, their count and median errors; none of them calls a vision model."""
    boundary = F.struct("boundary_idx", "coarse_t", F.date_format("old_dt", "yyyy-MM-dd").alias("old_date"), F.date_format("new_dt", "yyyy-MM-dd").alias("new_date"), "none_span_s", "true_change", "pipeline_cut", "placement_error_s", "coarse_error_s", F.lit(0).alias("vision_calls"))
    summary = F.struct(F.count("*").alias("count"), F.median("placement_error_s").alias("pipeline_median_error_s"), F.median("coarse_error_s").alias("coarse_median_error_s"), F.lit(0).alias("total_vision_calls"))
    return results.groupBy("tape_id").agg(F.array_sort(F.collect_list(boundary)).alias("boundaries"), summary.alias("summary"))


def write_results(results: DataFrame, path: str) -> None:
    """Evaluator results as JSON, `{boundaries, summary}` for each tape in a folder of its own; absent values are null."""
    result_documents(results).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("tape_id").json(path)
