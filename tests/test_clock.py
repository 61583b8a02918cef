"""Clock-stream operators on small cases with known results, and against sequential restatements on random tapes."""

import dataclasses
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions import parse, values
from tidemark.operators import clean, cutplan, evaluate, label, refine, sample, segment
from tidemark.sources import caches

D = dt.datetime


def _values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def _series(spark, rows, tape="a"):
    return spark.createDataFrame([(tape, float(t), c) for t, c in rows], "tape_id string, video_t double, cam_ts timestamp_ntz")


def _kept(df):
    return [r.video_t for r in df.orderBy("tape_id", "video_t").collect()]


# --- text ---


def _readings(spark, raws, column):
    df = parse.with_reading(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"))
    return [r[column] for r in df.orderBy("i").collect()]


def test_parse_timestamp(spark):
    cases = {
        "5:01 PM\n 1/ 4/90": D(1990, 1, 4, 17, 1),
        "2:30 PM 5/10/01": D(2001, 5, 10, 14, 30),
        "3:15 pm\r\n6/ 7/88": D(1988, 6, 7, 15, 15),
        "12:00 PM 6/ 1/99": D(1999, 6, 1, 12, 0),
        "12:00 AM 6/ 1/99": D(1999, 6, 1, 0, 0),
        "1:00 PM 1/ 1/1990": D(1990, 1, 1, 13, 0),
        "1:00:59 PM 1/1/90": D(1990, 1, 1, 13, 0),
        "1/ 4/90": D(1990, 1, 4, 0, 0),
        "5:01 1/ 4/90": D(1990, 1, 4, 0, 0),
        "5:01 PM JAN. 4 1990": D(1990, 1, 4, 17, 1),
        "dec 31 89 1:00 AM": D(1989, 12, 31, 1, 0),
        "13/ 4/90 JAN 4 90": None,
        "1/ 4/84": None,
        "1/ 4/06": None,
        "1/ 4/190": None,
        "2/30/90": None,
        "13:00 PM 1/ 4/90": None,
        "1 4 90": None,
        "": None,
    }
    assert _readings(spark, cases, "cam_ts") == list(cases.values())
    assert _readings(spark, [None], "cam_ts") == [None]


def test_parse_time_only(spark):
    cases = {"5:01 PM": 17 * 60 + 1, "12:05 AM": 5, "12:00 PM": 720, "5:01": None, "5:01 PM 1/4/90": None, "5:01 PM 99/99/99": None, "5:01 PM MAY 4 90": None, "5:71 PM": None, "x": None}
    assert _readings(spark, cases, "minute") == list(cases.values())


def test_eval_date_and_frame_index(spark):
    assert _values(spark, ["1/4/90", "1/4/84", "1/4/1990", "2/30/90", "NOISE"], "raw string", parse.eval_date(F.col("raw"))) == [D(1990, 1, 4), D(2084, 1, 4), None, None, None]
    assert _values(spark, ["/x/frame_000012.bmp"], "p string", parse.frame_index(F.col("p"))) == [12]
    with pytest.raises(Exception, match="not a frame"):
        _values(spark, ["/x/y.bmp"], "p string", parse.frame_index(F.col("p")))


def test_gap_class(spark):
    old, new = D(1990, 1, 4), D(1990, 1, 19)
    raws = {"1/19/90": "new", "/ 4/90": "old", "1//19 90": "new", "074/90": "old", "1/ /90": "noise", "4/90 19/90": "noise", "": "noise", "19/901": "noise"}
    assert _values(spark, [(r, old, new) for r in raws], "raw string, o timestamp_ntz, n timestamp_ntz", parse.gap_class(F.col("raw"), F.col("o"), F.col("n"))) == list(raws.values())


def test_values(spark):
    assert _values(spark, [(640, 480), (720, 480), (100, 50), (64, 48)], "w int, h int", values.bottom_band(F.col("w"), F.col("h"))) == ["560:130:40:350", "630:130:45:350", "100:60:0:-10", "100:60:0:-12"]
    assert _values(spark, [7.9, 123456.0], "s double", values.position_label(F.col("s"))) == ["00007s", "123456s"]


# --- samples ---


def test_vote_ties_and_fallback(spark):
    frames = [(0, "1/1/90"), (1, "1/2/90"), (2, "x"), (3, "1/3/90"), (4, "1/4/90"), (5, "1/4/90"), (6, "5:01 PM"), (7, "6:01 PM"), (8, ""), (9, ""), (10, ""), (11, "")]
    make = lambda rows: spark.createDataFrame([("a", i, r) for i, r in rows], "tape_id string, frame_idx int, raw string")
    got = {r.bucket: r for r in sample.vote(make(frames)).collect()}
    assert (got[0].cam_ts, got[0].raw) == (D(1990, 1, 1), "1/1/90") and got[1].cam_ts == D(1990, 1, 4)
    assert (got[2].cam_ts, got[2].raw) == (None, "5:01 PM") and got[3].raw is None
    assert got[0].video_t == pytest.approx(20 / 3)
    other = [(i, "2/2/91") for i, _ in frames]
    both = {r.bucket: r for r in sample.two_phase(make(frames), make(other)).collect()}
    assert both[3].cam_ts == D(1991, 2, 2) and both[2].cam_ts is None and both[2].raw == "5:01 PM"
    assert {r.bucket: r.raw for r in sample.two_phase(make(frames), make(other[:-1])).collect()}[3] is None


def _fill(rows):
    """Sequential restatement: (cam_ts, minute) rows in order."""
    first = next((c for c, _ in rows if c), None)
    out, day, before = [], first.date() if first else None, None
    for c, m in rows:
        if c:
            day, before = c.date(), c.hour * 60 + c.minute
            out.append(c)
        elif m is None or day is None:
            out.append(None)
        else:
            if before is not None and m < before - 720:
                day += dt.timedelta(days=1)
            before = m
            out.append(D.combine(day, dt.time(m // 60, m % 60)))
    return out


def test_fill_time_only(spark):
    rng = random.Random(1)
    tapes = []
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.random()
            rows.append((D(1990, 1, rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59)), None) if kind < 0.25 else (None, rng.randint(0, 1439)) if kind < 0.8 else (None, None))
        tapes.append(rows)
    df = spark.createDataFrame([(str(k), float(i), c, m) for k, rows in enumerate(tapes) for i, (c, m) in enumerate(rows)], "tape_id string, video_t double, cam_ts timestamp_ntz, minute int")
    got = {(r.tape_id, r.video_t): r.cam_ts for r in sample.fill_time_only(df).collect()}
    for k, rows in enumerate(tapes):
        assert [got[str(k), float(i)] for i in range(len(rows))] == _fill(rows)


# --- cleaning ---


def test_islands(spark):
    a, b, c = D(1990, 1, 1, 12), D(1990, 1, 2, 12), D(1990, 1, 3, 12)
    keep = lambda days: _kept(clean.drop_date_islands(_series(spark, list(enumerate(days)))))
    assert keep([a, b, a]) == [0, 2] and keep([a, None, b, None, a]) == [0, 1, 3, 4] and keep([a, b]) == [0, 1]
    assert keep([a, b, c, a]) == [0, 3] and keep([a, b, b, a]) == [0, 1, 2, 3] and keep([a, a, b]) == [0, 1, 2]


def test_digit_and_month_runs(spark):
    d = lambda *days: [D(1990, 1, x, 12) for x in days]
    assert _kept(clean.drop_digit_runs(_series(spark, list(enumerate([*d(14, 4, 4), None, *d(14)]))))) == [0, 3, 4]
    assert _kept(clean.drop_digit_runs(_series(spark, list(enumerate(d(14, 1, 1, 14)))))) == [0, 3]
    assert _kept(clean.drop_digit_runs(_series(spark, list(enumerate(d(14, 5, 5, 14)))))) == [0, 1, 2, 3]
    assert _kept(clean.drop_digit_runs(_series(spark, list(enumerate(d(4, 4, 14)))))) == [0, 1, 2]
    m = lambda *months: list(enumerate(D(1992, x, 9, 12) for x in months))
    assert _kept(clean.drop_month_runs(_series(spark, m(1, 5, 5, 1)))) == [0, 3] and _kept(clean.drop_month_runs(_series(spark, m(1, 6, 6, 1)))) == [0, 1, 2, 3]


def _year_runs(dates):
    """Sequential restatement over dates without nulls: kept positions."""
    runs = []
    for i, d in enumerate(dates):
        if runs and runs[-1][0] == d:
            runs[-1][1].append(i)
        else:
            runs.append((d, [i]))
    drop, p = set(), 0
    while len(runs) >= 3 and p < len(runs) - 1:
        left, q = runs[p][0], p + 1
        while q < len(runs) and runs[q][0].year != left.year and runs[q][0].month == left.month:
            q += 1
        if q > p + 1 and q < len(runs) and (runs[q][0].year, runs[q][0].month) == (left.year, left.month):
            drop.update(i for r in runs[p + 1 : q] for i in r[1])
            p = q
        else:
            p += 1
    return [float(i) for i in range(len(dates)) if i not in drop]


def test_year_runs(spark):
    rng = random.Random(2)
    tapes = [[dt.date(rng.choice([1990, 1990, 1991, 1992]), rng.choice([1, 1, 2]), rng.choice([1, 2])) for _ in range(rng.randint(1, 14))] for _ in range(150)]
    df = spark.createDataFrame([(str(k), float(i), D.combine(d, dt.time(12))) for k, t in enumerate(tapes) for i, d in enumerate(t)], "tape_id string, video_t double, cam_ts timestamp_ntz")
    got = {}
    for r in clean.drop_year_runs(df).orderBy("video_t").collect():
        got.setdefault(r.tape_id, []).append(r.video_t)
    wanted = [_year_runs(t) for t in tapes]
    assert [got[str(k)] for k in range(len(tapes))] == wanted and any(len(w) < len(t) for w, t in zip(wanted, tapes))


def _outliers(rows):
    agree = lambda a, b: abs((b[1] - a[1]).total_seconds() - (b[0] - a[0])) < 900
    out = []
    for i, x in enumerate(rows):
        before, after = rows[max(0, i - 4) : i], rows[i + 1 : i + 5]
        if not before or not after or any(agree(p, x) for p in before) or any(agree(x, n) for n in after) or not any(agree(p, n) for p in before for n in after):
            out.append(x[0])
    return out


def test_outliers(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [(10.0 * i, D(1990, 1, 1) + dt.timedelta(seconds=10 * i + rng.choice([0, 0, 0, 7200, -40_000, 90_000]))) for i in range(40)]
        assert _kept(clean.drop_outliers(_series(spark, [*rows, (500.0, None)]))) == _outliers(rows)


# --- segments ---


def test_boundaries_and_groups(spark):
    s = D(1990, 1, 1, 12)
    rows = [(0, s), (10, s + dt.timedelta(seconds=10)), (20, s + dt.timedelta(seconds=100)), (30, s + dt.timedelta(days=1)), (40, s)]
    found = segment.boundaries(_series(spark, rows))
    assert [(r.video_t, r.type, r.boundary_id) for r in found.orderBy("video_t").collect()] == [(20.0, "gap", 1), (30.0, "large_gap", 2), (40.0, "large_gap", 3)]
    tapes = spark.createDataFrame([("a", 50.0), ("z", 9.0)], "tape_id string, duration_s double")
    cuts = {m: sorted((r.tape_id, r.cut_t) for r in segment.group_cuts(found, tapes, m).collect()) for m in ("scene", "session", "daily", "other")}
    assert len(cuts["scene"]) == 5 and len(cuts["session"]) == 4 and len(cuts["daily"]) == 4 and cuts["other"] == [("a", 0.0), ("z", 0.0)]
    events = spark.createDataFrame([("a", 5.0), ("a", 45.0), ("z", 30.0)], "tape_id string, t double")
    assert {r.video_t for r in segment.fuse(found, events).collect()} == {20.0, 40.0}


@pytest.mark.parametrize("cuts, least, kept", [([0, 100, 102], 5, [0, 100]), ([0, 100, 105], 5, [0, 100, 105]), ([0, 100, 102, 104, 106], 5, [0, 100, 106]), ([0, 994, 1040, 1041, 1081], 5, [0, 994, 1040, 1081]), ([0, 100, 101], 0, [0, 100, 101]), ([0, 100, 90, 200], 5, [0, 100, 200]), ([0], 5, [0])])
def test_merge_short(spark, cuts, least, kept):
    df = spark.createDataFrame([("a", float(c), i - 1 if i else None) for i, c in enumerate(cuts)], "tape_id string, cut_t double, boundary_id long")
    assert [r.cut_t for r in segment.merge_short(df, least).collect()] == kept


def _orphans(cuts):
    cuts = list(cuts)
    changed = True
    while changed:
        changed = False
        for i in range(len(cuts) - 1):
            if cuts[i][1] and cuts[i + 1][1] and cuts[i + 1][0] - cuts[i][0] < 30:
                del cuts[i : i + 2]
                changed = True
                break
    return [c for c, _ in cuts]


def test_orphans(spark):
    rng = random.Random(4)
    tapes = [[(float(t), rng.random() < 0.7) for t in sorted(rng.sample(range(600), rng.randint(1, 20)))] for _ in range(60)]
    df = spark.createDataFrame([(str(k), c, g) for k, t in enumerate(tapes) for c, g in t], "tape_id string, cut_t double, garbled boolean")
    got = {}
    for r in segment.suppress_orphans(df).orderBy("cut_t").collect():
        got.setdefault(r.tape_id, []).append(r.cut_t)
    for k, t in enumerate(tapes):
        # A pair's removal can join its neighbours, which stand at least as far apart; sorted cuts need one pass.
        assert got.get(str(k), []) == _orphans(t)


def test_labels(spark):
    s = D(1990, 1, 1, 12)
    day = dt.timedelta(days=1)
    filtered = _series(spark, [(0, s), (10, s + dt.timedelta(seconds=10)), (20, s + 9 * day), (30, s + dt.timedelta(seconds=30)), (100, s + dt.timedelta(seconds=100)), (110, s + day), (120, s + day + dt.timedelta(seconds=10))])
    assert [r.confirmed for r in label.confirmed(filtered).orderBy("video_t").collect()] == [True, True, False, True, True, True, True]
    found = spark.createDataFrame([("a", 1, s)], "tape_id string, boundary_id long, cam_before timestamp_ntz")
    cuts = spark.createDataFrame([("a", 0.0, None), ("a", 15.0, None), ("a", 100.0, 1), ("a", 500.0, None)], "tape_id string, cut_t double, boundary_id long")
    tapes = spark.createDataFrame([("a", 600.0)], "tape_id string, duration_s double")
    clips = label.labelled(label.clip_bounds(cuts, tapes), filtered, found, "daily")
    rows = label.file_name(clips).orderBy("clip_no").collect()
    assert [r.label for r in rows] == ["1990-01-01", "1990-01-01", "1990-01-02", "00500s"] and rows[3].end_t == 600.0 and rows[2].file_name == "a_clip03_1990-01-02.mp4"
    assert [(r.clip_no, r.previous_s, r.duration_s) for r in label.same_date_neighbours(clips).collect()] == [(2, 15.0, 85.0)]
    assert label.labelled(label.clip_bounds(cuts, tapes), filtered, found, "session").orderBy("clip_no").first().label == "1990-01-01_1200"


# --- refinement ---

OLD, NEW = D(1990, 1, 4, 17, 0), D(1990, 1, 19, 9, 0)


def _refined(spark, readings, prev_t=50.0, coarse=60.0, after=NEW, events=None):
    found = spark.createDataFrame([("a", 1, coarse, after, prev_t, OLD)], "tape_id string, boundary_id long, video_t double, cam_after timestamp_ntz, prev_t double, prev_dt timestamp_ntz")
    table = spark.createDataFrame([("a", t, r) for t, r in readings.items()] or [("b", 0, "")], "tape_id string, t int, raw string")
    own = spark.createDataFrame([("a", t) for t in events], "tape_id string, t double") if events else None
    asked = []

    def read(requests):
        asked.append(requests)
        return refine.reader_of(table)(requests)

    r = refine.refine(found, read, own).collect()
    assert len(r) == 1
    return (r[0].cut_t, r[0].method, r[0].detail), asked


def test_short_policy(spark):
    old, new = "5:00 PM 1/ 4/90", "9:00 AM 1/19/90"
    result = lambda *a, **k: _refined(spark, *a, **k)[0]
    assert result({t: old for t in range(51, 55)} | {t: new for t in range(55, 70)}) == (55.0, "ocr", "")
    assert result({51: old, 52: old, 56: new}) == (53.0, "ocr", "")  # pure noise between
    assert result({51: old, 53: "19/90", 56: new}) == (53.0, "ocr", "")  # new-dated garble
    assert result({51: old, 53: "4/90", 56: new}) == (55.0, "ocr", "")  # old-dated garble
    assert result({51: old, 56: new}, events=[50.5, 53.5, 58.0]) == (53.5, "ocr", "")
    assert result({51: new, 52: old, 56: new}) == (53.0, "ocr", "")  # a lone new reading is reverted
    assert result({51: old, 55: "3:00 PM 1/12/90", 60: new}) == (56.0, "ocr", "")  # another date stays with the old side
    assert result({51: old, 57: "19/90"}) == (52.0, "ocr", "garbled-boundary")
    assert result({51: old}) == (52.0, "ocr", "garbled-boundary")
    assert result({51: old}, after=D(1990, 1, 4, 23, 0)) == (60.0, "coarse", "all-old-in-window")
    assert result({}, events=[49.0, 52.0, 57.5, 60.0]) == (57.5, "visual", "")
    assert result({}) == (60.0, "coarse", "SDZ 10s no-anchor")


def test_long_policy_and_guards(spark):
    old, new = "5:00 PM 1/ 4/90", "9:00 AM 1/19/90"
    r, asked = _refined(spark, {t: old for t in range(1, 120)} | {t: new for t in range(120, 210)}, 0.0, 200.0)
    assert r == (120.0, "ocr", "")
    assert sum(df.count() for df in asked[1:]) < 80  # the short policy's request is the first, and empty
    assert _refined(spark, {}, 0.0, 200.0)[0] == (200.0, "coarse", "LDZ 200s")
    assert _refined(spark, {t: old for t in range(1, 210)}, 0.0, 200.0, events=[100.0])[0] == (200.0, "coarse", "all-old-in-window")
    assert _refined(spark, {}, None, 200.0)[0] == (200.0, "coarse", "no-prev")
    found = spark.createDataFrame([("a", 1, 10.0, NEW, 60.0, OLD)], "tape_id string, boundary_id long, video_t double, cam_after timestamp_ntz, prev_t double, prev_dt timestamp_ntz")
    assert refine.refine(found, refine.reader_of(spark.createDataFrame([("a", 1, "")], "tape_id string, t int, raw string"))).first().detail == "empty-window"


def test_snap(spark):
    cuts = [(1, 100.0, None), (2, 200.0, None), (3, 300.0, 299.8), (4, 400.0, None)]
    scenes = [99.6, 198.0, 201.5, 299.7, 390.0]
    df = spark.createDataFrame([("a", *c) for c in cuts], "tape_id string, boundary_id long, cut_t double, prev_t double")
    got = {r.boundary_id: (r.snapped_t, r.snap_offset) for r in refine.snap(df, spark.createDataFrame([("a", s) for s in scenes], "tape_id string, t double")).collect()}
    assert got[1] == (99.6, pytest.approx(-0.4)) and got[2] == (201.5, 1.5) and got[3] == (300.0, None) and got[4] == (400.0, None)


# --- cut plan ---


def test_cut_plan(spark):
    lines = spark.createDataFrame([("a", x) for x in ("packet,95.0,K_", "packet,98.0,__", "packet,105.0,K_", "packet,N/A,K_", "packet,200.0,K__", "junk")], "tape_id string, line string")
    packets = cutplan.packets(lines)
    points = spark.createDataFrame([("a", 100.0), ("a", 95.0), ("a", 150.0), ("a", 20.0)], "tape_id string, t double")
    assert {r.t: r.k for r in cutplan.key_before(points, packets, "t", "k").collect()} == {100.0: 95.0, 95.0: 95.0, 150.0: 120.0, 20.0: 0.0}
    assert {r.t: r.k for r in cutplan.key_after(points, packets, "t", "k").collect()} == {100.0: 105.0, 95.0: 95.0, 150.0: 150.0, 20.0: 20.0}
    clips = spark.createDataFrame([("a", 1, 0.0, 100.0, None, 100.0, None, None), ("a", 2, 100.0, 200.0, 100.0, 200.0, False, None), ("a", 3, 101.0, 104.0, 101.0, 104.0, None, None)], "tape_id string, clip_no int, start_t double, end_t double, exact_start double, exact_end double, lead_video boolean, trail_video boolean")
    got = [(r.clip_no, r.seg_kind, r.seg_start, r.seg_end, r.action) for r in cutplan.segments(clips, packets).orderBy("clip_no", "seg_no").collect()]
    assert got == [(1, "body", 0.0, 95.0, "copy"), (1, "trail", 95.0, 100.0, "encode"), (2, "body", 105.0, 200.0, "copy"), (3, "lead", 101.0, 105.0, "encode"), (3, "trail", 95.0, 104.0, "encode")]


# --- evaluator ---


def test_evaluator(spark, tmp_path):
    raws = ["x", "1/1/90", None, None, "1/2/90", "1/2/90", None, "1/2/90", "1/3/90"]
    samples = spark.createDataFrame([("a", 10.0 * i, r) for i, r in enumerate(raws)], "tape_id string, video_t double, raw string")
    zones = evaluate.dead_zones(samples)
    assert [(r.coarse_t, r.prev_t, r.none_start, r.none_span_s) for r in zones.collect()] == [(40.0, 10.0, 20.0, 20.0)]
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"b041_t0030.png": "1/1/90", "b041_t0033.png": "NOISE", "b041_t0035.png": "1/2/90", "b041_t0036.png": "1/2/90", "b300_t1.png": "1/2/90", "other": "1/2/90"}))
    readings = caches.readings_map(spark, str(path), "a")
    clips = evaluate.clip_starts(spark.createDataFrame([("a", 2, "x_clip02_1990-01-02.mp4", 50.0), ("a", 1, "x_clip01_1990-01-01.mp4", 32.0)], "tape_id string, clip_no int, name string, duration_s double"))
    r = evaluate.results(zones, clips, readings)
    assert [(x.true_change, x.pipeline_cut, x.placement_error_s, x.coarse_error_s) for x in r.collect()] == [(35.0, 32.0, 3.0, 5.0)]
    s = evaluate.summary(r).first()
    assert (s.n, s.median_placement_error_s, s.mean_coarse_error_s) == (1, 3.0, 5.0)
    caches.write_results(r, str(tmp_path / "out"))
    out = json.loads(next((tmp_path / "out/tape_id=a").glob("*.json")).read_text())
    assert out["summary"] == {"count": 1, "pipeline_median_error_s": 3.0, "coarse_median_error_s": 5.0, "total_vision_calls": 0}
    assert [(b["boundary_idx"], b["old_date"], b["true_change"]) for b in out["boundaries"]] == [(1, "1990-01-01", 35.0)]


# --- sources ---


def test_caches(spark, tmp_path):
    settings = dataclasses.replace(DEFAULTS, crop="250:110:385:370")
    doc = {"cache_format": 5, "interval": 10, "crop": "250:110:385:370", "vf_preprocess": "f", "samples": [[6.667, "12:01 PM 1 / 1/90"], [16.667, None]]}
    path = tmp_path / "tape1_ocr_cache.json"
    path.write_text(json.dumps(doc))
    one = dataclasses.replace(settings, frames_per_sample=1)
    assert [tuple(r) for r in caches.sample_cache(spark, str(path), settings=one).collect()] == [("tape1", 6.667, "12:01 PM 1 / 1/90"), ("tape1", 16.667, None)]
    for other in (settings, dataclasses.replace(one, interval=5), dataclasses.replace(one, crop="1:1:1:1"), dataclasses.replace(one, cache_format=4)):
        assert caches.sample_cache(spark, str(path), settings=other).count() == 0
    visual = tmp_path / "v_visual_cache.json"
    visual.write_text(json.dumps({"cache_format": 1, "scene_threshold": 0.4, "black_min_duration": 0.1, "scene_cuts": [1.5, 9.0], "black_frames": [4.0]}))
    assert {tuple(r) for r in caches.visual_cache(spark, str(visual)).collect()} == {("v", 1.5, "scene"), ("v", 9.0, "scene"), ("v", 4.0, "black")}
    assert caches.visual_cache_mismatch(spark, str(visual), settings=dataclasses.replace(DEFAULTS, scene_threshold=0.3)).first().reasons == ["scene_threshold"]
    pretty = tmp_path / "w_visual_cache.json"
    pretty.write_text(json.dumps(json.loads(visual.read_text()), indent=1))
    assert caches.visual_cache(spark, str(pretty), multi_line=True).count() == 3


def test_caches_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("01", 10.0, "5:01 PM"), ("01", 99_999.5, None), ("a/b c", 20.0, 'x "y"\n'), ("01", 20.0, "")], "tape_id string, video_t double, raw string")
    caches.write_sample_cache(samples, str(tmp_path / "s"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(caches.sample_cache(spark, str(tmp_path / "s"))) == rows(samples)
    assert caches.sample_cache(spark, str(tmp_path / "s"), settings=dataclasses.replace(DEFAULTS, interval=3)).count() == 0
    events = spark.createDataFrame([("01", 1.5, "scene"), ("01", 90_000.0, "black"), ("a/b c", 2.0, "black")], "tape_id string, t double, kind string")
    caches.write_visual_cache(events, str(tmp_path / "v"))
    assert rows(caches.visual_cache(spark, str(tmp_path / "v"))) == rows(events)
    assert {tuple(r.reasons) for r in caches.visual_cache_mismatch(spark, str(tmp_path / "v")).collect()} == {()}
    readings = spark.createDataFrame([("01", 30, 41, "1/2/90"), ("01", 20_000, 7, "NOISE"), ("a+b", 30, 41, "1/3/90")], "tape_id string, coarse int, t int, raw string")
    caches.write_readings_map(readings, str(tmp_path / "r"))
    assert {(r.tape_id, r.coarse, r.t, r.dt) for r in caches.readings_map(spark, str(tmp_path / "r")).collect()} == {("01", 30, 41, D(1990, 1, 2)), ("01", 20_000, 7, None), ("a+b", 30, 41, D(1990, 1, 3))}


def test_rows_at_one_position_and_empty_tables(spark):
    """Repeated positions are ordered by their clocks, so results don't depend on how rows are dealt."""
    s = D(1990, 1, 1, 12)
    rows = [("a", 10.0 * (i // 2), s + dt.timedelta(hours=(i * 7) % 5)) for i in range(30)] * 2
    make = lambda r, n: spark.createDataFrame(r, "tape_id string, video_t double, cam_ts timestamp_ntz").repartition(n)
    results = {tuple(sorted(map(str, segment.boundaries(clean.clean(make(random.Random(n).sample(rows, len(rows)), n))).collect()))) for n in (1, 3)}
    assert len(results) == 1
    none = make([], 1)
    assert clean.clean(none).count() == 0 and segment.boundaries(none).count() == 0 and label.confirmed(none).count() == 0


def test_wire_and_logs(spark):
    lines = spark.createDataFrame([("/a/frame_000001.bmp\t5:01 PM\tx",), ("no tab",), ("/b\t",)], "line string")
    assert [(r.path, r.raw) for r in caches.wire_lines(lines).collect()] == [("/a/frame_000001.bmp", "5:01 PM\tx"), ("/b", "")]
    log = spark.createDataFrame([("a", "[showinfo] n:1 pts_time:12.5 x"), ("a", "[blackdetect] black_start:3.25 black_end:4"), ("a", "frame=1")], "tape_id string, line string")
    assert {(r.t, r.kind) for r in caches.visual_log(log).collect()} == {(12.5, "scene"), (3.25, "black")}


def test_registered_queries_have_columns_of_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
