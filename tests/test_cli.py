"""The command line reads tables, runs the plans and writes their results."""

import json

import pytest

from tidemark.__main__ import main
from tidemark.operators import evaluate

SAMPLES = [("a", 10.0 * i, f"5:{i:02d} PM 1/ {4 + i // 10}/90") for i in range(30)]
#: Two dates about four unreadable samples.
ZONE = [("z", 10.0 * i, "5:01 PM 1/ 4/90" if i < 5 else "" if i < 9 else "6:01 PM 1/ 5/90") for i in range(20)]


@pytest.fixture()
def paths(spark, tmp_path):
    tables = {
        "samples": (SAMPLES + ZONE, "tape_id string, video_t double, raw string"),
        "tapes": ([("a", 300.0), ("z", 200.0)], "tape_id string, duration_s double"),
        "readings": ([("a", float(t), f"5:{t // 10:02d} PM 1/ {4 + t // 100}/90") for t in range(300)], "tape_id string, t double, raw string"),
        "scene_cuts": ([("a", 99.0)], "tape_id string, t double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return lambda name: str(tmp_path / name)


def test_split(spark, paths):
    main(["split", "--samples", paths("samples"), "--tapes", paths("tapes"), "--out", paths("coarse")], spark)
    clips = spark.read.parquet(paths("coarse/clips")).groupBy("tape_id").count().collect()
    assert {(r.tape_id, r["count"]) for r in clips} == {("a", 3), ("z", 2)}
    assert spark.read.parquet(paths("coarse/boundaries")).count() == 3


def test_split_refined(spark, paths):
    tables = [x for name in ("samples", "tapes", "readings", "scene_cuts") for x in (f"--{name.replace('_', '-')}", paths(name))]
    main(["split", *tables, "--out", paths("fine")], spark)
    refined = spark.read.parquet(paths("fine/refined")).collect()
    assert {r.tape_id for r in refined} == {"a", "z"} and len(refined) == 3
    assert spark.read.parquet(paths("fine/clips")).where("tape_id = 'a'").count() == 3


def test_evaluate(spark, paths):
    clips = [{"tape_id": "z", "clip_no": 1, "name": "z_clip01_1990-01-04.mp4", "duration_s": 80.0}, {"tape_id": "z", "clip_no": 2, "name": "z_clip02_1990-01-05.mp4", "duration_s": 120.0}]
    with open(paths("clips.json"), "w") as out:
        out.write("\n".join(map(json.dumps, clips)))
    zones = evaluate.dead_zones(spark.read.parquet(paths("samples")))
    coarse = int(zones.first().coarse_t)
    with open(paths("dense.json"), "w") as out:
        out.write("\n".join(json.dumps({"tape_id": "z", "coarse": coarse, "t": t, "dt": dt}) for t, dt in ((70.0, "1990-01-04T17:01:00Z"), (75.0, "1990-01-05T18:01:00Z"))))
    main(["evaluate", "--samples", paths("samples"), "--clips", paths("clips.json"), "--dense", paths("dense.json"), "--out", paths("found")], spark)
    want = evaluate.results(zones, evaluate.clip_starts(spark.read.schema("tape_id string, clip_no int, name string, duration_s double").json(paths("clips.json"))), spark.read.schema("tape_id string, coarse int, t double, dt timestamp").json(paths("dense.json")))
    rows = want.collect()
    assert [(r.tape_id, r.true_change, r.pipeline_cut) for r in rows] == [("z", 75.0, 80.0)]
    got = spark.read.json(paths("found")).first()
    assert got.summary["count"] == 1 and got.boundaries[0].placement_error_s == rows[0].placement_error_s


def test_refused(spark, paths):
    for extra in (["--fuse"], ["--events", paths("scene_cuts")]):
        with pytest.raises(SystemExit):
            main(["split", "--samples", paths("samples"), "--tapes", paths("tapes"), "--out", paths("no"), *extra], spark)
