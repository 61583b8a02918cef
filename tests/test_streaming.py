"""The stream's parsing, counts and finished tapes equal the batch operators' on the same rows."""

import json

from tidemark.plans import pipeline
from tidemark.streaming import ingest


def test_tapes_finish_as_in_batch(spark, tmp_path):
    rows = [{"tape_id": "a", "video_t": 10.0 * i, "raw": f"5:{i:02d} PM 1/ {4 + i // 10}/90", "arrived": f"2024-01-01T00:0{i // 10}:00Z"} for i in range(30)]
    rows[-1]["duration_s"] = 300.0
    rows.append({"tape_id": "open", "video_t": 0.0, "raw": "5:01 PM", "arrived": "2024-01-01T00:00:00Z"})
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k * 11 : (k + 1) * 11])))
    stream = ingest.readings(spark, str(source))
    got = []
    q = ingest.finish_tapes(stream, str(tmp_path / "kept"), lambda clips, number: got.extend(clips.collect()), str(tmp_path / "c1"))
    q.awaitTermination(120)
    batch = spark.createDataFrame([(r["tape_id"], r["video_t"], r["raw"]) for r in rows[:30]], "tape_id string, video_t double, raw string")
    tapes = spark.createDataFrame([("a", 300.0)], "tape_id string, duration_s double")
    assert sorted(map(str, got)) == sorted(map(str, pipeline.dry_run(batch, tapes).clips.collect())) and len(got) == 3
    q = ingest.yields(stream).writeStream.outputMode("complete").format("memory").queryName("yields").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.tape_id, r.n, r.n_read) for r in spark.table("yields").collect()} == {("a", 10, 10), ("open", 1, 1)}
