"""Command line over tables in Parquet or JSON lines: `python -m tidemark split …` and `python -m tidemark evaluate …`."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import DEFAULTS
from tidemark.operators import evaluate, refine
from tidemark.plans import pipeline
from tidemark.sources import caches, store

#: The columns that each table is read with.
SCHEMAS = {
    "samples": "tape_id string, video_t double, raw string",
    "tapes": "tape_id string, duration_s double",
    "readings": "tape_id string, t double, raw string",
    "events": "tape_id string, t double",
    "scene_cuts": "tape_id string, t double",
    "clips": "tape_id string, clip_no int, name string, duration_s double",
    "dense": "tape_id string, coarse int, t double, dt timestamp",
}


def _table(spark: SparkSession, kind: str, path: str | None) -> DataFrame | None:
    """The table at path: JSON lines if it ends in .json, else Parquet; None without a path."""
    if path is None:
        return None
    schema = SCHEMAS[kind]
    if path.rstrip("/").endswith(".json"):
        return spark.read.schema(schema).json(path)
    return spark.read.parquet(path).selectExpr(*[f"CAST(`{c.split()[0]}` AS {c.split()[1]}) AS `{c.split()[0]}`" for c in schema.split(", ")])


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    split = commands.add_parser("split", help="labelled clips of samples; refined where readings are given")
    split.add_argument("--samples", required=True)
    split.add_argument("--tapes", required=True)
    split.add_argument("--readings", help="denser readings, by which cuts are refined")
    split.add_argument("--events", help="visual events")
    split.add_argument("--scene-cuts")
    split.add_argument("--mode", choices=("scene", "session", "daily"), default=DEFAULTS.mode)
    split.add_argument("--fuse", action="store_true", help="only boundaries near a visual event")
    split.add_argument("--out", required=True, help="folder for clips, boundaries and (with readings) refined, as Parquet")
    check = commands.add_parser("evaluate", help="errors of clips' starts at dead zones")
    check.add_argument("--samples", required=True)
    check.add_argument("--clips", required=True)
    check.add_argument("--dense", required=True, help="dated readings around coarse positions")
    check.add_argument("--out", required=True, help="folder for a JSON document of each tape")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs a command in spark, or in a session of its own. split replaces what an earlier run wrote of the same tapes; results of other tapes stay."""
    parser = _parser()
    given = parser.parse_args(argv)
    if given.command == "split" and given.fuse and not given.events:
        parser.error("--fuse needs --events")
    if given.command == "split" and not given.readings and (given.events or given.scene_cuts):
        parser.error("--events and --scene-cuts need --readings")
    own = spark is None
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    def table(kind: str) -> DataFrame | None:
        return _table(spark, kind, getattr(given, kind))

    if given.command == "split":
        settings = dataclasses.replace(DEFAULTS, mode=given.mode)
        if given.readings:
            result = pipeline.run(table("samples"), table("tapes"), refine.reader_of(table("readings")), table("events"), table("scene_cuts"), given.fuse, settings)
            store.write_by_tape(result.refined, f"{given.out}/refined", table("tapes"))
        else:
            result = pipeline.dry_run(table("samples"), table("tapes"), settings)
        store.write_by_tape(result.clips, f"{given.out}/clips", table("tapes"))
        store.write_by_tape(result.boundaries, f"{given.out}/boundaries", table("tapes"))
    else:
        zones = evaluate.dead_zones(table("samples"))
        caches.write_results(evaluate.results(zones, evaluate.clip_starts(table("clips")), table("dense")), given.out)
    if own:
        spark.stop()


if __name__ == "__main__":
    main()
