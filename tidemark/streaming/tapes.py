"""Boundaries of tapes as their readings arrive, from a bounded state for each tape.

transformWithState keeps for a tape what the rules still need: the last clock and date, for readings with a time only;
a few readings whose neighbours ahead haven't come; the last clean reading and the number of boundaries. The rules are
those of the batch operators fill_time_only, drop_date_islands, drop_outliers and boundaries, in this order, and so are
the boundaries; the three rules on runs of dates look ahead without bound and are left to batches.

* Rows of a tape may come out of order by up to `settle_s` seconds of position; they are held and sorted until one that
  is as far ahead has come. A row at or before a position already worked on is late: it is counted and left out.
* Readings without a date before a tape's first dated one are held until that one comes, which dates them.
* A tape ends with the row that has its duration, or when no row has arrived for `idle`, by the watermark of `arrived`.
  Then what is held is worked off. Rows of a tape that has ended are late.

Each boundary is emitted once, in append mode; a tape that ends emits a row of type 'end', whose cam_jump_s is the number
of late rows. The state survives a restart from the query's checkpoint.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.values import clock

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "tape_id STRING, boundary_id BIGINT, video_t DOUBLE, type STRING, cam_before TIMESTAMP_NTZ, cam_after TIMESTAMP_NTZ, cam_jump_s BIGINT, prev_t DOUBLE"
_DAY, _EPOCH = 86_400, dt.datetime(1970, 1, 1)


class Tape:
    """The rules over one tape, row by row; clocks are whole seconds. Its fields are all that it remembers."""

    FIELDS = ("held", "at", "early", "minute", "day", "island", "island_before", "before", "ahead", "last", "n", "late", "ended")

    def __init__(self, settings: Settings, settle_s: float, saved: dict | None = None) -> None:
        self.s, self.settle = settings, settle_s
        self.held, self.early, self.before, self.ahead = [], [], [], []  # rows out of order; undated ones; those around the ones in question
        self.at = self.minute = self.day = self.island = self.island_before = self.last = None
        self.n = self.late = 0
        self.ended = False
        self.__dict__.update(saved or {})

    def saved(self) -> dict:
        return {k: getattr(self, k) for k in self.FIELDS}

    def add(self, rows: list[tuple[float, int | None, int | None]], end: bool = False) -> list[tuple]:
        """Boundaries that rows (position, clock, minute of a reading without a date) make known."""
        for row in rows:
            if self.ended or (self.at is not None and row[0] <= self.at):
                self.late += 1
            else:
                self.held.append(list(row))
        out = []
        if self.held:
            self.held.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            upto = self.held[-1][0] - self.settle
            ready = [r for r in self.held if end or r[0] <= upto]
            self.held = self.held[len(ready) :]
            for r in ready:
                self.at = r[0]
                for t, c in self._dated(*r):
                    out += self._island(t, c)
        if end and not self.ended:
            self.ended, rest = True, self.island
            self.island = None
            if rest:
                out += self._clean(*rest)
            while self.ahead:
                out += self._decide()
            self.early = self.before = []
        return out

    def _dated(self, t: float, c: int | None, minute: int | None) -> Iterator[tuple[float, int]]:
        if c is not None:
            self.day, self.minute = c // _DAY, c % _DAY // 60
            held, self.early = self.early, []
            if held:
                # Readings before the first date count from it, with the midnights that passed among them.
                day, before = self.day, None
                for x, m in held:
                    day, before = day + (before is not None and m < before - self.s.wrap_minutes), m
                    yield x, day * _DAY + m * 60
            yield t, c
        elif minute is not None and self.day is None:
            self.early.append([t, minute])
        elif minute is not None:
            self.day += minute < self.minute - self.s.wrap_minutes
            self.minute = minute
            yield t, self.day * _DAY + minute * 60

    def _island(self, t: float, c: int) -> list[tuple]:
        out, mid = [], self.island
        if mid:
            day = mid[1] // _DAY
            if self.island_before is None or day == self.island_before or day == c // _DAY:
                out = self._clean(*mid)
            self.island_before = day
        self.island = [t, c]
        return out

    def _clean(self, t: float, c: int) -> list[tuple]:
        self.ahead.append([t, c])
        return self._decide() if len(self.ahead) > self.s.most_run + 1 else []

    def _decide(self) -> list[tuple]:
        """Whether the first reading ahead agrees with its neighbours; if it is kept, its boundary."""
        (t, c), *rest = self.ahead
        agree = lambda a, b: abs((a[1] - a[0]) - (b[1] - b[0])) < self.s.most_drift
        near = any(agree((t, c), r) for r in self.before + rest)
        keep = not self.before or not rest or near or not any(agree(a, b) for a in self.before for b in rest)
        self.before = [*self.before, [t, c]][-(self.s.most_run + 1) :]
        self.ahead = rest
        if not keep:
            return []
        last, self.last = self.last, [t, c]
        if last is None:
            return []
        gain, moved = c - last[1], t - last[0]
        back = gain < self.s.backward
        if not (gain > moved + self.s.least_gap or back):
            return []
        self.n += 1
        return [(self.n, t, "large_gap" if gain > moved + self.s.large_gap or back else "gap", last[1], c, gain, last[0])]


class Boundaries(StatefulProcessor):
    def __init__(self, settings: Settings, settle_s: float, idle_ms: int) -> None:
        self.settings, self.settle, self.idle = settings, settle_s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tape", "tape STRING, timer BIGINT")

    def _load(self) -> tuple[Tape, int | None]:
        text, timer = self.state.get() if self.state.exists() else (None, None)
        return Tape(self.settings, self.settle, json.loads(text) if text else None), timer

    def _rows(self, tape_id: str, tape: Tape, found: list[tuple], ended: bool) -> pd.DataFrame:
        when = lambda c: _EPOCH + dt.timedelta(seconds=c)
        rows = [(tape_id, n, t, kind, when(a), when(b), gain, prev) for n, t, kind, a, b, gain, prev in found]
        if ended:
            rows.append((tape_id, tape.n, tape.at, "end", None, None, tape.late, None))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tape, timer = self._load()
        whole = pd.concat(list(rows))
        known = lambda x: None if pd.isna(x) else int(x)
        end = bool(whole["duration_s"].notna().any())
        was = tape.ended
        found = tape.add([(float(t), known(c), known(m)) for t, c, m in zip(whole["video_t"], whole["clock"], whole["minute"])], end)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if tape.ended else max(int(whole["arrived_ms"].max()), timer - self.idle if timer else 0) + self.idle
        if timer is not None:
            self.handle.registerTimer(timer)
        self.state.update((json.dumps(tape.saved()), timer))
        yield self._rows(key[0], tape, found, tape.ended and not was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tape, _ = self._load()
        was = tape.ended
        found = tape.add([], end=True)
        self.state.update((json.dumps(tape.saved()), None))
        yield self._rows(key[0], tape, found, not was)


def boundaries(stream: DataFrame, settle_s: float = 60.0, idle: str = "1 hour", late: str = "10 minutes", settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, boundary_id, video_t, type, cam_before, cam_after, cam_jump_s, prev_t) of a stream (tape_id, video_t, cam_ts, minute, arrived, duration_s), as far as they are known."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.withWatermark("arrived", late).select("tape_id", "video_t", clock(F.col("cam_ts")).alias("clock"), "minute", "arrived", F.unix_millis("arrived").alias("arrived_ms"), "duration_s")
    return rows.groupBy("tape_id").transformWithStateInPandas(Boundaries(settings, settle_s, idle_ms), OUTPUT, "Append", "EventTime")
