"""Whole refined runs, bisection, clock models and calibration against sequential restatements."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.operators import evaluate, label, model, refine, sample, segment
from tidemark.plans import pipeline, queries
from tidemark.sources import tables

D = dt.datetime
SF = "/root/testdata/sf0.001"


# --- whole run ---


def _orphans(cuts, garbled, gap=30.0):
    """List and set of positions: neighbouring pairs of garbled positions go, from the left, until there are none."""
    garbled = set(garbled)
    while True:
        out, k, found = [], 0, False
        while k < len(cuts):
            if k + 1 < len(cuts) and cuts[k] in garbled and cuts[k + 1] in garbled and cuts[k + 1] - cuts[k] < gap:
                garbled -= {cuts[k], cuts[k + 1]}
                k, found = k + 2, True
            else:
                out.append(cuts[k])
                k += 1
        cuts = out
        if not found:
            return cuts


def test_orphans_of_listed_cuts(spark):
    """Coinciding cuts and cuts that go back."""
    rng = random.Random(4)
    rows, want = [], set()
    for tape in range(300):
        t, cuts, flags = 0.0, [], []
        for _ in range(rng.randint(0, 12)):
            t = max(0.0, t + rng.choice([0, 0, 5, 10, 29, 30, 80, -7]))
            cuts.append(t)
            flags.append(rng.random() < 0.7)
        rows += [(str(tape), k + 1, c, g) for k, (c, g) in enumerate(zip(cuts, flags))]
        want |= {(str(tape), c, n) for c in set(cuts) if (n := _orphans(cuts, {c for c, g in zip(cuts, flags) if g}).count(c))}
    df = spark.createDataFrame(rows, "tape_id string, boundary_id long, cut_t double, garbled boolean").repartition(3)
    got = segment.suppress_listed_orphans(df).groupBy("tape_id", "cut_t").count().collect()
    assert {tuple(r) for r in got} == want and len(want) < len(rows) / 2


def _sequential(tape_id, duration, chosen, refined, filtered, sure, mode, settings):
    """A tape's clips (start, end, label) from refined boundaries, cut by cut."""
    cuts, by_cut, garbled = [0.0], {}, set()
    for b in sorted(chosen, key=lambda b: b.boundary_id):
        r = refined[b.boundary_id]
        cuts.append(r.cut_t)
        by_cut[r.cut_t] = b
        if r.detail == "garbled-boundary":
            garbled.add(r.cut_t)
    kept = []
    for t in _orphans(cuts, garbled):
        if not kept or t - kept[-1] >= settings.clip_floor():
            kept.append(t)
    out = []
    for k, t in enumerate(kept):
        old = by_cut[t].cam_before.date() if t in by_cut else None
        ahead = [c for x, c in filtered if x >= t]
        good = [c for x, c in sure if x >= t and c.date() != old]
        at = good[0] if good else ahead[0] if ahead else None
        form = "%Y-%m-%d" if mode == "daily" else "%Y-%m-%d_%H%M"
        out.append((tape_id, k + 1, t, kept[k + 1] if k + 1 < len(kept) else duration, at.strftime(form) if at else f"{int(t):05d}s"))
    return out


@pytest.mark.parametrize("mode", ["daily", "session"])
def test_refined_run_equals_a_sequential_one(spark, mode):
    settings = dataclasses.replace(DEFAULTS, mode=mode, large_gap=300)
    s, r = queries._with_dead_zones(spark, SF)
    tapes, events = tables.tapes(spark, SF), tables.visual_events(spark, SF).select("tape_id", "t")
    result = pipeline.run(s, tapes, refine.reader_of(r), events, events, settings=settings)
    by = lambda df: {t: [x for x in rows if x.tape_id == t] for rows in [df.collect()] for t in {x.tape_id for x in rows}}
    filtered, chosen, refined = by(result.filtered), by(segment.chosen(result.boundaries, mode)), by(result.refined)
    sure = by(label.confirmed(result.filtered, settings).where("confirmed"))
    want = []
    for t in tapes.collect():
        pairs = lambda of: sorted((x.video_t, x.cam_ts) for x in of.get(t.tape_id, []))  # noqa: B023, E731
        want += _sequential(t.tape_id, t.duration_s, chosen.get(t.tape_id, []), {x.boundary_id: x for x in refined.get(t.tape_id, [])}, pairs(filtered), pairs(sure), mode, settings)
    got = [(c.tape_id, c.clip_no, c.start_t, c.end_t, c.label) for c in result.clips.collect()]
    assert sorted(got) == sorted(want) and len(got) > 5
    methods = {x.method for rows in refined.values() for x in rows}
    assert len(methods) > 1 and "ocr" in methods


def test_reads_of_a_dead_zone(spark):
    """How many seconds the long policy asks for: far fewer than the window has."""
    found = spark.createDataFrame([("a", 1, 200.0, 0.0, D(1990, 1, 4, 17, 0), D(1990, 1, 4, 17, 10))], "tape_id string, boundary_id long, video_t double, prev_t double, prev_dt timestamp_ntz, cam_after timestamp_ntz")
    settings = dataclasses.replace(DEFAULTS, interval=1, large_gap=300)
    old, new = "5:00 PM\n 1/ 4/90", "5:10 PM\n 1/ 4/90"
    for raws, most, cut, method in (
        (lambda t: old if t < 100 else new, 79, 100.0, "ocr"),
        (lambda t: old if t < 50 else new, 79, 50.0, "ocr"),
        (lambda t: None, 52, 200.0, "coarse"),
        (lambda t: new if t == 1 else None, 52, 1.0, "ocr"),
        (lambda t: old if t < 199 else new, 60, 199.0, "ocr"),
    ):
        table = spark.createDataFrame([("a", t, raws(t)) for t in range(1, 201)], "tape_id string, t int, raw string").where("raw IS NOT NULL")
        asked = []

        def read(requests, table=table, asked=asked):
            asked.append(requests.count())
            return refine.reader_of(table)(requests)

        r = refine.refine(found, read, None, settings).collect()[0]
        assert sum(asked) <= most and (r.cut_t, r.method) == (cut, method)


# --- bisection ---


def _search(lo, hi, old, label_of):
    """One zone after the other."""
    calls = 0

    def new(t):
        nonlocal calls
        found = label_of(t)
        calls += found is not None
        return found not in (None, "NOISE", "NONE", old)

    while hi - lo > 2:
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if new(mid) else (mid, hi)
    t = lo
    while t <= hi:
        if new(t):
            return t, calls
        t += 1
    return hi, calls


def test_bisection(spark):
    rng = random.Random(7)
    zones, labels = [], {}
    for k in range(60):
        tape, lo = str(k % 4), rng.uniform(0, 900)
        zones.append((tape, k, lo, lo + rng.choice([0.5, 2.0, 7.0, 65.0, 300.0]), "1990-01-01"))
    for tape in range(4):
        change = rng.uniform(0, 1200)
        for t in range(1300):
            if rng.random() < 0.93:
                labels[str(tape), t] = rng.choice(["NOISE", "NONE"]) if rng.random() < 0.1 else "1990-01-01" if t < change else "1990-01-02"
    z = spark.createDataFrame(zones, "tape_id string, boundary_id long, lo double, hi double, old string")
    table = spark.createDataFrame([(a, t, x) for (a, t), x in labels.items()], "tape_id string, t int, label string")
    asked = []

    def read(requests):
        asked.append(requests.count())
        return evaluate.labels_of(table)(requests)

    got = {r.boundary_id: (r.true_change, r.calls) for r in evaluate.bisected(z, read).collect()}
    want = {k: _search(lo, hi, old, lambda t, tape=tape: labels.get((tape, int(t)))) for tape, k, lo, hi, old in zones}
    assert got == want
    assert len(asked) == 9 and max(asked) <= 60 * 4
    assert evaluate.bisected(z.limit(0), evaluate.labels_of(table)).count() == 0


# --- clock models ---


def test_models(spark):
    rng = random.Random(2)
    base, rows = D(1990, 1, 4, 12, 0), []
    for seg, (n, slope) in enumerate([(40, 2.0), (5, 1.0), (4, 2.0), (6, 1.5)]):
        rows += [("a", 1000.0 * seg + 10 * k, base + dt.timedelta(days=seg, minutes=int(slope * 10 * k) // 60), seg) for k in range(n)]
    rows[20] = ("a", rows[20][1], rows[20][2] + dt.timedelta(hours=9), 0)
    rows += [("b", 5.0, base, 0)] * 7
    df = spark.createDataFrame(rows, "tape_id string, video_t double, cam_ts timestamp_ntz, segment long").repartition(3)
    got = {(r.tape_id, r.segment): r for r in model.models(df).collect()}
    for key, r in got.items():
        own = [(x[1], (x[2] - base).total_seconds()) for x in rows if (x[0], x[3]) == key]
        mx, my = sum(x for x, _ in own) / len(own), sum(y for _, y in own) / len(own)
        spread = sum((x - mx) ** 2 for x, _ in own)
        if len(own) < 5 or spread == 0:
            assert r.slope is None
        else:
            slope = sum((x - mx) * (y - my) for x, y in own) / spread
            expected = my - slope * mx
            assert r.slope == pytest.approx(slope) and r.c0 + r.slope * (0 - r.t0) + r.intercept - values_of(base) == pytest.approx(expected, abs=1e-3)
    kept = {(r.tape_id, r.video_t) for r in model.drop_misfits(df, model.models(df)).collect()}
    assert {(x[0], x[1]) for x in rows} - kept == {("a", rows[20][1])} | {("a", x[1]) for x in rows if x[0] == "a" and x[3] == 0 and abs((x[2] - base).total_seconds() - got["a", 0].slope * x[1] - got["a", 0].intercept) > 300}
    samples = spark.createDataFrame([("a", t) for t in (5.0, 15.0, 395.0, 1005.0, 2005.0, 3045.0, 3055.0)] + [("a", 10.0)], "tape_id string, video_t double")
    found = {r.video_t: r for r in model.predictions(samples, df, model.models(df)).collect()}
    # Between segments, beyond the last reading and in a segment without a line nothing is predicted.
    assert set(found) == {5.0, 15.0, 1005.0, 3045.0} and all(r.source == "model" for r in found.values())
    m = got["a", 1]
    assert values_of(found[1005.0].cam_ts) == int(m.c0 + m.slope * (1005.0 - m.t0) + m.intercept)


def values_of(ts):
    return int((ts - D(1970, 1, 1)).total_seconds())


# --- calibration ---


def test_calibrate(spark):
    tapes = spark.createDataFrame([("a", 2100.0, 640, 480), ("b", 2100.0, None, 480), ("c", 2100.0, 320, 40), ("d", 2100.0, 640, 480)], "tape_id string, duration_s double, width int, height int")

    def read(requests):
        asked = requests.collect()
        assert {r.tape_id for r in asked} == {"a", "c", "d"} and len(asked) == 60 and {r.crop for r in asked if r.tape_id == "a"} == {"560:130:40:350"}
        raw = F.when(F.col("t") < 500, F.lit("5:01 PM 1/ 4/90")).when(F.col("t") < 1000, F.lit("5:01 PM")).when(F.col("t") < 1500, F.lit("?"))
        return requests.withColumn("raw", F.when(F.col("tape_id") != "d", raw))

    got = {r.tape_id: tuple(r)[1:] for r in sample.calibrate(tapes, read).collect()}
    assert got == {"a": ("560:130:40:350", 14, 9, 9 / 14, True), "b": (DEFAULTS.crop, None, None, None, False), "c": (f"280:60:20:{40 - 60}", 14, 9, 9 / 14, True), "d": ("560:130:40:350", 0, 0, 0.0, True)}
