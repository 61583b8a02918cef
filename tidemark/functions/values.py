"""Column expressions of clocks, labels and crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings


def clock(ts: Column) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ since 1970, whatever the session's time zone."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another."""
    return clock(end) - clock(start)


def drift(t_a: Column, ts_a: Column, t_b: Column, ts_b: Column) -> Column:
    """By how much two readings' clocks and positions disagree."""
    return F.abs(seconds(ts_a, ts_b) - (t_b - t_a))


def jumped(t_a: Column, ts_a: Column, t_b: Column, ts_b: Column, settings: Settings = DEFAULTS) -> Column:
    """The clock gained more than the position did, or went back."""
    gain = seconds(ts_a, ts_b)
    return (gain > t_b - t_a + settings.least_gap) | (gain < settings.backward)


def confusable_months(a: Column, b: Column) -> Column:
    """Months whose digits look alike."""
    low, high = F.least(a, b), F.greatest(a, b)
    return ((low == 1) & (high == 5)) | ((low == 8) & (high == 9))


def position_label(start: Column) -> Column:
    """Whole seconds, five digits at least, and an s."""
    whole = F.floor(start).cast("string")
    return F.concat(F.when(F.length(whole) < 5, F.lpad(whole, 5, "0")).otherwise(whole), F.lit("s"))


def label(ts: Column, start: Column, mode: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd" if mode == "daily" else "yyyy-MM-dd_HHmm"), position_label(start))


def bottom_band(width: Column, height: Column) -> Column:
    """Crop w:h:x:y of the band where the clock is burned in, by the frame's proportions; x stays inside the frame, y need not.

    Fixed values: the band of the default crop in a frame of 640 by 480.
    """
    w = F.greatest(F.lit(100), F.bround(width * 560 / 640).cast("int"))
    h = F.greatest(F.lit(60), F.bround(height * 130 / 480).cast("int"))
    x = F.greatest(F.lit(0), F.least(F.bround(width * 40 / 640).cast("int"), width - w))
    return F.concat_ws(":", *[c.cast("string") for c in (w, h, x, height - h)])
