"""Joins of tables that are small on disk and many rows: none may be gathered in the driver to be broadcast."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, label
from tidemark.plans import queries
from tidemark.sources import caches

DAY = dt.datetime(1990, 1, 4)


@pytest.fixture()
def stored(spark, tmp_path):
    """A function that puts rows into a file, of which the planner knows the size."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return put


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def zones(stored):
    rows = [(tape, 100.0, 50.0, 60.0, 40.0, DAY, DAY + dt.timedelta(days=1)) for tape in "ab"]
    return stored("zones", rows, "tape_id string, coarse_t double, prev_t double, none_start double, none_span_s double, old_dt timestamp_ntz, new_dt timestamp_ntz")


def test_evaluator(stored, zones):
    clips = evaluate.clip_starts(stored("clips", [("a", 1, "a_clip01_1990-01-04.mp4", 90.0), ("a", 2, "a_clip02_1990-01-05.mp4", 10.0)], "tape_id string, clip_no int, name string, duration_s double"))
    readings = stored("readings", [("a", 101, t, DAY + dt.timedelta(days=int(t >= 95))) for t in range(90, 106)], "tape_id string, coarse int, t int, dt timestamp_ntz")
    got = evaluate.results(zones, clips, readings)
    assert "SortMergeJoin" in _planned(got) and "Broadcast" not in _planned(got)
    assert [(r.tape_id, r.true_change, r.pipeline_cut) for r in got.collect()] == [("a", 95.0, 90.0)]


def test_readings_around_zones(spark, stored, zones, monkeypatch):
    table = stored("seconds", [("a", t, "5:01 PM 1/ 4/90") for t in range(200)], "tape_id string, t int, raw string")
    monkeypatch.setattr(queries.tables, "readings", lambda spark, sf_dir: table)
    joined, written = [], queries.shared.written
    monkeypatch.setattr(queries.shared, "written", lambda df, what: joined.append(df) or written(df, what))
    got = queries._eval_readings(spark, "", zones)
    # Written once, for the evaluator reads it twice.
    assert len(joined) == 1 and "Join" not in _planned(got)
    assert "SortMergeJoin" in _planned(joined[0]) and "Broadcast" not in _planned(joined[0])
    assert got.agg(F.count("*"), F.min("t"), F.max("t"), F.min("coarse")).first()[:] == (16, 90, 105, 101)


def test_labels(stored):
    filtered = stored("filtered", [("a", 10.0 * i, DAY + dt.timedelta(days=i // 5, seconds=10 * i)) for i in range(10)], "tape_id string, video_t double, cam_ts timestamp_ntz")
    found = stored("found", [("a", 1, DAY)], "tape_id string, boundary_id bigint, cam_before timestamp_ntz")
    clips = stored("bounds", [("a", 1, 0.0, 50.0, None), ("a", 2, 50.0, 100.0, 1)], "tape_id string, clip_no int, start_t double, end_t double, boundary_id bigint")
    got = label.labelled(clips, filtered, found, "daily")
    assert "Broadcast" not in _planned(got)
    assert [r.label for r in got.orderBy("clip_no").collect()] == ["1990-01-04", "1990-01-05"]


def test_documents(stored, zones):
    clips = evaluate.clip_starts(stored("clips", [("a", 1, "a_clip01_1990-01-05.mp4", 90.0)], "tape_id string, clip_no int, name string, duration_s double"))
    readings = stored("readings", [("a", 101, 101, DAY + dt.timedelta(days=1))], "tape_id string, coarse int, t int, dt timestamp_ntz")
    got = caches.result_documents(evaluate.results(zones, clips, readings))
    assert "Broadcast" not in _planned(got)
    assert [(r.tape_id, len(r.boundaries), r.summary["count"], r.summary.pipeline_median_error_s) for r in got.collect()] == [("a", 1, 1, 101.0)]
