"""Streamed boundaries equal those of the batch operators, across batches, disorder, idle tapes and a restart."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_tiles import _tape
from tidemark.config import DEFAULTS
from tidemark.operators import clean, sample, segment
from tidemark.streaming import ingest, tapes


def _batch(spark, rows):
    df = spark.createDataFrame(rows, "tape_id string, video_t double, raw string")
    filled = sample.fill_time_only(sample.parsed(df)).select("tape_id", "video_t", "cam_ts")
    found = segment.boundaries(clean.drop_outliers(clean.drop_date_islands(filled)))
    return {tuple(r) for r in found.select("tape_id", "boundary_id", "video_t", "type", "cam_before", "cam_after", "cam_jump_s", "prev_t").collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = {}
    for name, n in (("a", 250), ("b", 90), ("idle", 60), ("one", 1)):
        own = {}
        for t, raw in _tape(rng, n):
            own.setdefault(t, raw)
        out[name] = sorted(own.items())
    out["early"] = [(10.0 * k, f"{(7 * k) % 12 or 12}:00 {'PM' if k % 5 else 'AM'}" + (" 3/ 4/91" if k > 30 else "")) for k in range(1, 50)]
    return out


def _write(path, part, rows):
    (path / f"{part:02d}.json").write_text("\n".join(json.dumps({k: v for k, v in zip(("tape_id", "video_t", "raw", "arrived", "duration_s"), r) if v is not None}) for r in rows))


def test_streamed_boundaries(spark, rows, tmp_path):
    folder, checkpoint, out = tmp_path / "in", f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/out"
    folder.mkdir()
    rng = random.Random(3)
    arriving = []
    for name, own in rows.items():
        order = list(own)
        # Out of order by a few rows: within the time that is waited for.
        for k in range(0, len(order) - 1, 7):
            if order[k + 1][0] - order[k][0] <= 60:
                order[k], order[k + 1] = order[k + 1], order[k]
        arriving += [[name, t, raw, k] for k, (t, raw) in enumerate(order)]
    arriving.sort(key=lambda r: (r[3], rng.random()))
    ends = {n: max(t for t, _ in own) + 10 for n, own in rows.items() if n != "idle"}
    parts = [arriving[k : k + 80] for k in range(0, len(arriving), 80)]
    stamp = lambda p: f"2024-01-01T{p // 60:02d}:{p % 60:02d}:00Z"

    def go():
        stream = ingest.readings(spark, str(folder))
        query = tapes.boundaries(stream, settle_s=600.0, idle="30 minutes", late="1 minute").writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        return query

    # Every run goes on from the checkpoint of the one before.
    third = len(parts) // 2
    for p, part in enumerate(parts):
        _write(folder, p, [(n, t, raw, stamp(p), None) for n, t, raw, _ in part])
        if p in (third, len(parts) - 1):
            go()
    _write(folder, 50, [(n, end, None, stamp(len(parts)), end) for n, end in ends.items()] + [("a", rows["a"][3][0], "1:00 AM 1/ 1/90", stamp(len(parts)), None)])
    _write(folder, 51, [("clock", 10.0, None, stamp(len(parts) + 60), None)])
    go()
    _write(folder, 52, [("clock", 20.0, None, stamp(len(parts) + 200), None), ("a", 1e6, "1:00 AM 1/ 1/90", stamp(len(parts) + 200), None)])
    go()
    got = spark.read.schema(tapes.OUTPUT).json(out)
    found = [tuple(r) for r in got.where("type <> 'end'").collect()]
    assert set(found) == _batch(spark, [(n, t, raw) for n, own in rows.items() for t, raw in own]) and len(found) == len(set(found)) > 50
    over = {r.tape_id: (r.boundary_id, r.cam_jump_s) for r in got.where("type = 'end'").collect()}
    assert set(over) == set(rows) and over["a"][1] == 1 and over["idle"][1] == 0


def test_state_is_bounded(rows):
    """What a tape remembers doesn't grow with what it has seen."""
    tape, sizes = tapes.Tape(DEFAULTS, 60.0), []
    for k in range(20_000):
        tape.add([(10.0 * k, 600_000_000 + 10 * k + (5000 if k % 97 == 0 else 0), None)])
        sizes.append(len(json.dumps(tape.saved())))
    assert max(sizes[10_000:]) < 1_000 and max(sizes[10_000:]) < max(sizes[:1_000]) * 1.2
    again = tapes.Tape(DEFAULTS, 60.0, json.loads(json.dumps(tape.saved())))
    assert again.add([], end=True) == tape.add([], end=True)


def test_late_rows():
    tape = tapes.Tape(DEFAULTS, 0.0)
    tape.add([(10.0, 600_000_000, None), (20.0, 600_000_010, None)])
    tape.add([(15.0, 600_000_000, None)])
    assert tape.late == 1
    tape.add([], end=True)
    tape.add([(30.0, 600_000_030, None)])
    assert tape.late == 2 and tape.ended
