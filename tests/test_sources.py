"""Store, clip table, recogniser, frame source and named policies."""

import dataclasses
import datetime as dt
import json
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.operators import refine
from tidemark.sources import frames, recogniser, store

D = dt.datetime


# --- store ---


def test_store(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []
    tapes = spark.createDataFrame([("a",), ("b",), ("empty",), ("7",)], "tape_id string")

    def scan(wanted):
        names = sorted(r.tape_id for r in wanted.collect())
        asked.append(names)
        return spark.createDataFrame([(n, float(t), f"{n}{t}") for n in names if n != "empty" for t in range(3)], "tape_id string, video_t double, raw string")

    rows = lambda df: sorted((r.tape_id, r.video_t, r.raw) for r in df.collect())
    want = sorted((n, float(t), f"{n}{t}") for n in ("a", "b", "7") for t in range(3))
    assert len(rows(store.scanned(tapes.where("tape_id = 'a'"), path, scan))) == 3
    assert rows(store.scanned(tapes, path, scan)) == want
    assert rows(store.scanned(tapes, path, scan)) == want
    assert asked == [["a"], ["7", "b", "empty"]]  # a second run scans nothing, also of a tape without samples
    # A changed setting scans again, and leaves what the other one has.
    other = dataclasses.replace(DEFAULTS, interval=20)
    assert rows(store.scanned(tapes, path, scan, other)) == want and asked[-1] == ["7", "a", "b", "empty"]
    assert rows(store.scanned(tapes, path, scan)) == want and len(asked) == 3
    assert store.settings_key() != store.settings_key(vf_preprocess="gray")
    # A run that broke off after its samples: they are replaced, not doubled.
    broken = str(tmp_path / "broken")
    store.replace_partitions(scan(tapes).select("video_t", "raw", F.lit(store.settings_key()).alias("key"), "tape_id"), f"{broken}/samples", ["key", "tape_id"])
    assert rows(store.scanned(tapes, broken, scan)) == want


def test_clips_of_a_rerun(spark, tmp_path):
    path = str(tmp_path / "clips")
    make = lambda rows: spark.createDataFrame(rows, "tape_id string, clip_no int, label string")
    tapes = lambda *names: spark.createDataFrame([(n,) for n in names], "tape_id string")
    rows = lambda: sorted((r.tape_id, r.clip_no, r.label) for r in store.by_tape(spark, path, "clip_no").collect())
    store.write_by_tape(make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "w")]), path, tapes("a", "b", "c"))
    store.write_by_tape(make([("a", 1, "new")]), path, tapes("a"))
    assert rows() == [("a", 1, "new"), ("b", 1, "z"), ("c", 1, "w")]
    store.write_by_tape(make([]), path, tapes("b"))
    assert rows() == [("a", 1, "new"), ("c", 1, "w")]


# --- recogniser ---

FAKE = r"""
import os, sys
for line in sys.stdin:
    path = line.rstrip("\n")
    if path.startswith("crash") and not os.path.exists(sys.argv[1]):
        open(sys.argv[1], "w").close()
        os._exit(3)
    if path.startswith("die"):
        os._exit(4)
    if path.startswith("skip"):
        continue
    if path.startswith("hang"):
        import time
        time.sleep(60)
    print(path if path.startswith("bare") else f"{path}\ttext\tof {path}", flush=True)
"""


def test_recogniser(spark, tmp_path):
    program = tmp_path / "fake.py"
    program.write_text(FAKE)
    mark = tmp_path / "crashed"
    paths = [f"p{k}" for k in range(300)]
    paths[50], paths[51], paths[120], paths[200], paths[201] = "crash1", "skip1", "bare1", "die1", "die2"
    df = spark.createDataFrame(list(enumerate([*paths, None, "é 漢"])), "k int, path string").coalesce(1)
    got = recogniser.recognised(df, [sys.executable, str(program), str(mark)], batch=64, timeout_s=20).collect()
    assert [r.k for r in got] == list(range(302)) and mark.exists()
    for r in got:
        # A crash costs the path that it happened at; what is left out or answered without a tab is empty.
        empty = r.path is None or r.path in ("crash1", "skip1", "bare1", "die1", "die2")
        assert r.raw == ("" if empty else f"text\tof {r.path}"), r
    assert recogniser.recognised(df.limit(0), ["no such program"]).count() == 0
    own = recogniser.Program([sys.executable, str(program), str(mark)], timeout_s=1.0)
    assert own.read(["a", "hang", "b"]) == ["text\tof a", "", "text\tof b"] and own.starts == 2
    own.close()


# --- frames ---


def decode(path, times, crop, preprocess):
    """Every seventh second can't be decoded; others say what was asked."""
    for t in times:
        yield None if int(t) % 7 == 3 else f"{path}@{t:.3f} {crop} {preprocess}".encode()


def test_frames(spark):
    tapes = [("a", "/v/a", 100.0), ("b", "/v/b", 35.0)]
    options = {"interval": "10", "span": "20", "crop": "1:2:3:4"}
    df = frames.load(spark, spark.createDataFrame(tapes, "tape_id string, path string, duration_s double"), "tests.test_sources:decode", **options)
    step = 10 / 3
    want = {(n, k, k * step) for n, _, d in tapes for k in range(100) if k * step < d and int(k * step) % 7 != 3}
    got = df.collect()
    assert {(r.tape_id, r.frame_idx, r.t) for r in got} == want and len(got) == len(want)
    assert bytes(got[0].data).decode().endswith(" 1:2:3:4 False")
    some = df.where("t > 20 AND t <= 60 AND tape_id = 'a'").collect()
    assert {(r.tape_id, r.frame_idx, r.t) for r in some} == {x for x in want if x[0] == "a" and 20 < x[2] <= 60}
    # Seeks: any position; one that fails has null data.
    sought = {(r.tape_id, r.frame_idx, r.t): r.data for r in df.where(F.col("t").isin(10.0, 12.25, 17.0)).collect()}
    assert set(sought) == {(n, k, t) for n in "ab" for k, t in ((3, 10.0), (None, 12.25), (None, 17.0))}
    assert sought["a", None, 17.0] is None and bytes(sought["b", None, 12.25]).startswith(b"/v/b@12.250")
    # What is outside is never planned or decoded.
    reader = frames.FrameReader(options | {"tapes": json.dumps(tapes)})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    assert list(reader.pushFilters([EqualTo(("tape_id",), "a"), GreaterThanOrEqual(("t",), 40.0), LessThan(("t",), 50.0), EqualTo(("frame_idx",), 3)])) == [EqualTo(("frame_idx",), 3)]
    pieces = reader.partitions()
    assert {p.tape_id for p in pieces} == {"a"} and sum(p.high - p.low for p in pieces) <= 4


# --- policies ---


def test_policies(spark):
    def middle(rows):
        """Half way between the last old and the first new reading."""
        old = [r["t"] for r in rows if r["side"] == "old"]
        new = [r["t"] for r in rows if r["side"] == "new" and r["t"] > (old[-1] if old else 0)]
        return ((old[-1] + new[0]) / 2, "mine", f"{len(rows)} readings") if old and new else (rows[0]["video_t"], "coarse", "")

    found = spark.createDataFrame(
        [("a", 1, 60.0, 30.0, D(1990, 1, 4, 17, 0), D(1990, 1, 4, 19, 10)), ("a", 2, 400.0, 100.0, D(1990, 1, 4, 19, 11), D(1990, 1, 9, 9, 0)), ("b", 1, 50.0, None, None, D(1990, 1, 1))],
        "tape_id string, boundary_id long, video_t double, prev_t double, prev_dt timestamp_ntz, cam_after timestamp_ntz",
    )
    raw = lambda t: "5:00 PM 1/ 4/90" if t < 40 else "" if t < 50 else "7:10 PM 1/ 4/90" if t < 200 else "9:00 AM 1/ 9/90"
    readings = spark.createDataFrame([("a", t, raw(t)) for t in range(450)], "tape_id string, t int, raw string")
    read = refine.reader_of(readings)
    refine.register_policy("middle", refine.placing_policy(middle))
    got = {(r.tape_id, r.boundary_id): tuple(r)[2:] for r in refine.refine(found, read, short="middle", long="coarse").collect()}
    assert got == {("a", 1): (44.5, "mine", "39 readings"), ("a", 2): (400.0, "coarse", ""), ("b", 1): (50.0, "coarse", "no-prev")}
    # The same in SQL.
    spark.udtf.register("place_middle", refine.placement(middle))
    own = refine.judged(read(refine.dense_requests(refine.windowed(found.where("boundary_id = 1 AND tape_id = 'a'")))))
    own.createOrReplaceTempView("own_readings")
    rows = spark.sql("SELECT * FROM place_middle(TABLE(own_readings) PARTITION BY (tape_id, boundary_id) ORDER BY t)").collect()
    assert [tuple(r) for r in rows] == [("a", 1, 44.5, "mine", "39 readings")]
    with pytest.raises(KeyError):
        refine.refine(found, read, short="unknown")
    plain = refine.refine(found, read)
    assert {r.method for r in plain.collect()} <= {"ocr", "coarse"}
