"""Tapes in tiles give the rows of whole tapes, and walks those of folds."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.operators import clean, label, sample, segment, tiles, walk
from tidemark.plans import pipeline

D = dt.datetime


def _tape(rng, n):
    """A noisy tape: clocks that run, jump and are misread, unreadable and time-only readings, stretches without any."""
    now, rows, t = D(1990, rng.randint(1, 12), rng.randint(1, 28), 10, 0), [], 0.0
    while len(rows) < n:
        t += rng.choice([10, 10, 10, 10, 60, 500])
        now += dt.timedelta(minutes=rng.choice([0, 1, 1, 2, 90, 700]) if rng.random() < 0.3 else 0)
        if rng.random() < 0.04:
            now += dt.timedelta(days=rng.choice([1, 2, 15, -3, 365]))
        seen, kind = now, rng.random()
        if kind < 0.06:
            seen = now.replace(day=max(1, now.day % 10 or 1))
        elif kind < 0.12:
            seen = now.replace(month={1: 5, 5: 1, 8: 9, 9: 8}.get(now.month, now.month), day=min(now.day, 28))
        elif kind < 0.2:
            seen = now.replace(year=now.year + rng.choice([1, 9]), day=min(now.day, 28))
        elif kind < 0.25:
            seen = now + dt.timedelta(hours=11)
        clock = f"{seen.hour % 12 or 12}:{seen.minute:02d} {'PM' if seen.hour >= 12 else 'AM'}"
        for _ in range(rng.choice([1] * 20 + [2])):
            form = rng.random()
            rows.append((t, None if form < 0.12 else clock if form < 0.35 else f"{clock} {seen.month}/ {seen.day}/{seen.year % 100}"))
    return rows


@pytest.fixture(scope="module")
def tapes(spark):
    rng = random.Random(21)
    rows = [(name, t, raw) for name, n in (("a", 220), ("b#1", 90), ("c", 3), ("", 40)) for t, raw in _tape(rng, n)]
    rows += [("timed", 10.0 * k, f"{k % 12 or 12}:00 AM") for k in range(1, 40)] + [("none", 10.0 * k, "x") for k in range(1, 9)]
    rows += [("late", 10.0 * k, f"{(k * 5) % 12 or 12}:0{k % 10} {'PM' if k % 3 else 'AM'}" + (" 3/ 4/91" if k > 60 else "")) for k in range(1, 80)]
    # Rows at one position differ, so that their order is told by what they say.
    samples = spark.createDataFrame(sorted(set(rows), key=repr), "tape_id string, video_t double, raw string").repartition(3)
    own = samples.groupBy("tape_id").agg((F.max("video_t") + 10).alias("duration_s"))
    return samples.cache(), own.cache()


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("tile_s", [45.0])
def test_each_rule_in_tiles(spark, tapes, tile_s):
    settings = dataclasses.replace(DEFAULTS, tile_s=tile_s)
    parsed = sample.parsed(tapes[0], settings).drop("raw")
    # One row for a position, as order within it is open before readings are dated.
    parsed = parsed.groupBy("tape_id", "video_t").agg(F.max("cam_ts").alias("cam_ts"), F.max("minute").alias("minute"))
    whole, own = parsed, tiles.tiled(parsed, settings=settings)
    steps = [(sample.fill_time_only, tiles.fill_time_only), (clean.drop_date_islands, tiles.drop_date_islands), (clean.drop_year_runs, lambda s: tiles.drop_year_runs(s, block=8)), (clean.drop_digit_runs, tiles.drop_digit_runs), (clean.drop_month_runs, tiles.drop_month_runs), (clean.drop_outliers, tiles.drop_outliers), (label.confirmed, tiles.confirmed)]
    counts = []
    for one, other in steps:
        whole, got = one(whole), other(own)
        rows = _rows(whole)
        assert _rows(got.drop("tile")) == rows, one.__name__
        counts.append(len(rows))
        whole = spark.createDataFrame(whole.toArrow())
        own = tiles.tiled(whole, settings=settings)
    assert all(a > b for a, b in zip(counts[:5], counts[1:])), counts


@pytest.mark.parametrize(("tile_s", "mode"), [(45.0, "scene"), (5000.0, "daily")])
def test_runs_in_tiles(tapes, tile_s, mode):
    settings = dataclasses.replace(DEFAULTS, tile_s=tile_s, mode=mode)
    samples = tapes[0].groupBy("tape_id", "video_t").agg(F.max("raw").alias("raw"))
    want = pipeline.dry_run(samples, tapes[1], dataclasses.replace(settings, long_tape_s=1e12))
    filtered, found, clips = tiles.dry_run(samples, tapes[1], settings)
    for got, one in ((filtered, want.filtered), (found, want.boundaries), (clips, want.clips)):
        assert _rows(got) == _rows(one)
    assert clips.count() > 10
    if mode == "scene":
        return
    # Tapes long and short in one run.
    mixed = pipeline.dry_run(samples, tapes[1], dataclasses.replace(settings, long_tape_s=1000.0))
    assert _rows(mixed.clips) == _rows(want.clips) and _rows(mixed.filtered) == _rows(want.filtered)


def _folded(cuts, least):
    out = []
    for t in cuts:
        if not out or t - out[-1] >= least:
            out.append(t)
    return out


@pytest.mark.parametrize("least", [0.0, 3.0])
def test_merge_short_as_a_walk(spark, least):
    rng = random.Random(5)
    rows, want = [], []
    for tape in range(12):
        cuts, t = [0.0], 0.0
        for _ in range(rng.choice([0, 1, 30, 200])):
            t += rng.choice([0, 1, 2, 7, 30, 100]) if rng.random() < 0.9 else -rng.choice([1, 5, 60])
            cuts.append(max(0.0, t))
        rows += [(str(tape), c, k or None) for k, c in enumerate(cuts)]
        want += [(str(tape), c) for c in _folded(cuts, least)]
    df = spark.createDataFrame(rows, "tape_id string, cut_t double, boundary_id long").repartition(3)
    for tile_s, block in ((20.0, 4), (1e6, 4096))[: 2 if least else 1]:
        got = tiles.merge_short(df, least, dataclasses.replace(DEFAULTS, tile_s=tile_s), block)
        assert sorted((r.tape_id, r.cut_t) for r in got.collect()) == sorted(want)
        assert got.columns == df.columns
    assert sorted((r.tape_id, r.cut_t) for r in segment.merge_short(df, least).collect()) == sorted(want)


def test_walks(spark):
    rng, rows, want = random.Random(1), [], set()
    for tape in range(8):
        n = rng.choice([1, 2, 50, 300])
        nx = [None if rng.random() < 0.002 or x >= n else x for x in (k + rng.choice([1, 1, 2, 3, 9, 40]) for k in range(n))]
        rows += [(str(tape), k + 5, None if x is None else x + 5) for k, x in enumerate(nx)]
        k = 0
        while k is not None:
            want.add((str(tape), k + 5))
            k = nx[k]
    df = spark.createDataFrame(rows, "tape_id string, i long, nx long").repartition(3)
    for block in (4, 37, 4096):
        assert {tuple(r) for r in walk.walked(df, block).collect()} == want
    assert walk.walked(df.limit(0)).count() == 0


def test_a_walk_of_a_million_cuts(spark):
    """One tape; each step is one or two numbers, so half a million nodes and more are visited."""
    n = 1_000_000
    nodes = spark.range(n).select(F.lit("a").alias("tape_id"), F.col("id").alias("i"), (F.col("id") + 1 + F.pmod(F.xxhash64("id"), F.lit(2))).alias("nx"))
    nodes = nodes.withColumn("nx", F.when(F.col("nx") < n, F.col("nx")))
    got = walk.walked(nodes).agg(F.count("*").alias("n"), F.sum("i").alias("s")).first()
    pointers = [r.nx for r in nodes.orderBy("i").select("nx").toLocalIterator()]
    k, count, total = 0, 0, 0
    while k is not None:
        count, total, k = count + 1, total + k, pointers[k]
    assert (got.n, got.s) == (count, total)
