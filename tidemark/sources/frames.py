"""Frames of tapes as a data source: bulk scans and single seeks through one reader, with an injected decoder.

`load(spark, tapes, "module:function")` has a row for each frame of a scan: (tape_id, frame_idx, t, data). Frames stand interval / frames_per_sample seconds apart from 0. A tape is read in
ranges of `span` seconds, a task each. Filters on tape_id and t reach the source: tapes and ranges outside are never
planned, frames outside never decoded. `t = x` and `t IN (…)` seek those positions, wherever they are, and such rows have
no frame_idx unless they are a scan's.

decoder(path, times, crop, preprocess) yields one frame's bytes for each time, or None where it fails. A seek that fails
has null data; in a scan a frame that fails is left out, as it has no file.

The plan lists the ranges, so the table of tapes (an id, a path and a length for each) passes the driver; frames don't.
The decoder's module must be importable by the workers.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "tidemark_frames"


@dataclass
class Piece(InputPartition):
    """A range of a tape's frames [low, high), or the positions of a seek."""

    tape_id: str
    path: str
    low: int = 0
    high: int = 0
    times: tuple[float, ...] = ()


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.step = float(options.get("interval", 10)) / int(options.get("frames_per_sample", 3))
        self.low, self.high = 0.0, math.inf
        self.low_open = self.high_open = False
        self.times: set[float] | None = None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what narrows t and tape_id; the rest, and nothing else, is left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("t", "tape_id") and isinstance(f, (EqualTo, In)):
                values = {x for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                mine = "times" if name == "t" else "only"
                held = getattr(self, mine)
                setattr(self, mine, values if held is None else held & values)
            elif name == "t" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                if (f.value, isinstance(f, GreaterThan)) > (self.low, self.low_open):
                    self.low, self.low_open = f.value, isinstance(f, GreaterThan)
            elif name == "t" and isinstance(f, (LessThan, LessThanOrEqual)):
                if (f.value, isinstance(f, LessThanOrEqual)) < (self.high, not self.high_open):
                    self.high, self.high_open = f.value, isinstance(f, LessThan)
            else:
                yield f

    def _inside(self, t: float) -> bool:
        return (t > self.low if self.low_open else t >= self.low) and (t < self.high if self.high_open else t <= self.high)

    def _tapes(self) -> list[tuple[str, str, float]]:
        return [tuple(x) for x in json.loads(self.options["tapes"])]

    def partitions(self) -> list[InputPartition]:
        each = max(1, round(float(self.options.get("span", 3600)) / self.step))
        out: list[InputPartition] = []
        for tape_id, path, duration in self._tapes():
            if self.only is not None and tape_id not in self.only:
                continue
            if self.times is not None:
                times = tuple(sorted(t for t in self.times if self._inside(t)))
                out += [Piece(tape_id, path, times=times[k : k + each]) for k in range(0, len(times), each)]
                continue
            n = math.ceil(duration / self.step)
            low = max(0, math.floor(self.low / self.step))
            high = n if self.high == math.inf else min(n, math.floor(self.high / self.step) + 1)
            out += [Piece(tape_id, path, k, min(k + each, high)) for k in range(low, high, each)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        module, _, name = self.options["decoder"].partition(":")
        decode = getattr(importlib.import_module(module), name)
        seek = bool(partition.times)
        wanted = [(None, t) for t in partition.times] if seek else [(k, t) for k in range(partition.low, partition.high) if self._inside(t := k * self.step)]
        crop, preprocess = self.options.get("crop", ""), self.options.get("preprocess", "false").lower() == "true"
        for (k, t), data in zip(wanted, decode(partition.path, [t for _, t in wanted], crop, preprocess), strict=True):
            if seek:
                k = round(t / self.step)
                yield partition.tape_id, k if k * self.step == t else None, t, data
            elif data is not None:
                yield partition.tape_id, k, t, data


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "tape_id STRING, frame_idx INT, t DOUBLE, data BINARY"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters reaching it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def load(spark: SparkSession, tapes: DataFrame, decoder: str, **options: str) -> DataFrame:
    """Frames of tapes (tape_id, path, duration_s); options: interval, frames_per_sample, span, crop, preprocess."""
    register(spark)
    rows = tapes.selectExpr("CAST(tape_id AS STRING)", "CAST(path AS STRING)", "CAST(duration_s AS DOUBLE)").collect()
    return spark.read.format(NAME).options(tapes=json.dumps([list(r) for r in rows]), decoder=decoder, **options).load()
