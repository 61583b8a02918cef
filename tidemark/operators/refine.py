"""Refinement of cuts from denser readings: requests, transitions, placement, policies, snapping to scene cuts.

Readings are a table (tape_id, t, raw) or any function from requests (tape_id, boundary_id, t) to it. What a boundary's
readings show is found by windows over one partitioning by boundary; a boundary asks for the seconds of its window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import parse
from tidemark.functions.values import seconds
from tidemark.operators.joins import asof

KEY = ["tape_id", "boundary_id"]
Reader = Callable[[DataFrame], DataFrame]
#: What every request and reading carries of its boundary.
_CARRIED = ["video_t", "prev_t", "prev_dt", "cam_after", "lo", "hi", "span"]


def _of() -> WindowSpec:
    """All rows of a boundary."""
    return Window.partitionBy(*KEY)


def reader_of(readings: DataFrame) -> Reader:
    """A reader of a table: every requested position gets a row, with '' where the table has none."""

    def read(requests: DataFrame) -> DataFrame:
        return requests.join(readings.select("tape_id", "t", "raw"), ["tape_id", "t"], "left").withColumn("raw", F.coalesce("raw", F.lit("")))

    return read


def windowed(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Boundaries with their window [lo, hi] of whole seconds and span, null without a reading before."""
    lo = F.floor("prev_t").cast("int") + 1
    hi = F.floor("video_t").cast("int") + settings.interval - 1
    return found.withColumns({"lo": lo, "hi": hi, "span": F.col("video_t") - F.col("prev_t")})


def _step() -> Column:
    """Two seconds, or as many as make about fifty positions of a window."""
    return F.greatest(F.lit(2), F.floor((F.col("hi") - F.col("lo") + 1) / 50).cast("int"))


def dense_requests(windows: DataFrame) -> DataFrame:
    """(tape_id, boundary_id, t, …): every second of each window."""
    return windows.where("lo <= hi").select(*KEY, *_CARRIED, F.explode(F.sequence("lo", "hi")).alias("t"))


def coarse_requests(windows: DataFrame) -> DataFrame:
    """(tape_id, boundary_id, t, …): about fifty seconds of each window, two apart at least."""
    return windows.where("lo <= hi").select(*KEY, *_CARRIED, F.explode(F.sequence("lo", "hi", _step())).alias("t"))


def judged(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Answered requests with cam_ts and side: 'new' if the clock jumped to the date expected, 'old' if legible else, null if not."""
    out = parse.with_reading(readings, "raw", settings, minute=None)
    gain = seconds(F.col("prev_dt"), F.col("cam_ts"))
    new = (gain > F.col("t") - F.col("prev_t") + settings.large_gap) | (gain < settings.backward)
    expected = F.coalesce(F.to_date("cam_ts") == F.to_date("cam_after"), F.lit(True))
    return out.withColumn("side", F.when(F.col("cam_ts").isNotNull(), F.when(new & expected, "new").otherwise("old")))


def with_transition(own: DataFrame) -> DataFrame:
    """own with its boundary's any_ocr, last_old (the last old reading, else prev_t), and first_new with new_dt: the first new reading after that."""
    last = F.max(F.when(F.col("side") == "old", F.col("t").cast("double"))).over(_of())
    out = own.withColumn("any_ocr", (F.count("side").over(_of()) > 0)).withColumn("last_old", F.coalesce(last, "prev_t"))
    first = F.min(F.when((F.col("side") == "new") & (F.col("t") > F.col("last_old")), F.struct("t", "cam_ts"))).over(_of())
    return out.withColumn("__new", first).withColumns({"first_new": F.col("__new.t").cast("double"), "new_dt": F.col("__new.cam_ts")}).drop("__new")


def transition(own: DataFrame) -> DataFrame:
    """(tape_id, boundary_id, any_ocr, last_old, first_new, new_dt) of judged readings."""
    return with_transition(own).select(*KEY, "any_ocr", "last_old", "first_new", "new_dt").distinct()


def _gap(own: DataFrame) -> DataFrame:
    """One row for each boundary of own (…, last_old, upper, upper_dt): last_garble, the last old-dated garble between the two, and garble_new, the first new-dated one after it."""
    inside = (F.col("t") > F.col("last_old")) & (F.col("t") < F.col("upper"))
    seen = own.withColumn("cls", F.when(inside, parse.gap_class(F.col("raw"), F.col("prev_dt"), F.col("upper_dt"))))
    seen = seen.withColumn("last_garble", F.max(F.when(F.col("cls") == "old", F.col("t"))).over(_of()))
    later = (F.col("cls") == "new") & (F.col("last_garble").isNull() | (F.col("t") > F.col("last_garble")))
    carried = [c for c in ("video_t", "prev_t", "prev_dt", "cam_after", "span", "any_ocr", "last_old", "first_new", "upper", "upper_dt", "last_garble")]
    return seen.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in carried], F.min(F.when(later, F.col("t"))).cast("double").alias("garble_new"))


def placed(anchor: Column | None = None) -> Column:
    """The cut across the unreadable gap between last_old and upper.

    In this order: without a change of date a second before upper; at the first new-dated garble; behind old-dated
    garble a second before upper; at the last visual event inside; a second after last_old.
    """
    late = F.greatest(F.col("last_old") + 1, F.col("upper") - 1)
    same = F.col("upper_dt").isNull() | (F.to_date("upper_dt") == F.to_date("prev_dt"))
    behind = F.col("last_old") + 1
    return F.when(same, late).when(F.col("garble_new").isNotNull(), F.col("garble_new")).when(F.col("last_garble").isNotNull(), late).otherwise(behind if anchor is None else F.coalesce(anchor, behind))


def _result(of: DataFrame, *outcomes: tuple[Column, Column, str, Column]) -> DataFrame:
    """The first outcome (when, cut, method, detail) that holds, for each boundary."""
    cut = method = detail = None
    for when, c, m, d in outcomes:
        cut = F.when(when, c) if cut is None else cut.when(when, c)
        method = F.when(when, m) if method is None else method.when(when, m)
        detail = F.when(when, d) if detail is None else detail.when(when, d)
    return of.select(*KEY, cut.cast("double").alias("cut_t"), method.alias("method"), detail.alias("detail"))


def short_policy(windows: DataFrame, read: Reader, events: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, boundary_id, cut_t, method, detail) of windows shorter than a dead zone, from one dense pass."""
    own = with_transition(judged(read(dense_requests(windows)), settings))
    # Without a new reading, new-dated garble behind the last old one bounds the gap.
    garble = (F.col("t") > F.col("last_old")) & (F.col("raw") != "") & F.col("first_new").isNull() & (parse.gap_class(F.col("raw"), F.col("prev_dt"), F.col("cam_after")) == "new")
    own = own.withColumn("upper", F.coalesce("first_new", F.min(F.when(garble, F.col("t").cast("double"))).over(_of()))).withColumn("upper_dt", F.when(F.col("first_new").isNotNull(), F.col("new_dt")).otherwise(F.col("cam_after")))
    out = _gap(own)
    inside = before = F.lit(None).cast("double")
    if events is not None:
        t = events.select("tape_id", "t")
        out = asof(asof(out, t, "upper", "t", "__in", strict=True), t, "video_t", "t", "__before", strict=True)
        inside = F.when(F.col("__in.t") > F.col("last_old"), F.col("__in.t"))
        before = F.when(F.col("__before.t") >= F.col("prev_t"), F.col("__before.t"))
    changed = F.coalesce(F.to_date("prev_dt") != F.to_date("cam_after"), F.lit(False))
    coarse = F.col("video_t")
    return _result(
        out,
        (F.col("first_new").isNotNull(), placed(inside), "ocr", F.lit("")),
        (F.col("any_ocr") & changed, F.when(F.col("upper").isNotNull(), placed(inside)).otherwise(F.col("last_old") + 1), "ocr", F.lit("garbled-boundary")),
        (F.col("any_ocr"), coarse, "coarse", F.lit("all-old-in-window")),
        (before.isNotNull(), before, "visual", F.lit("")),
        (F.lit(True), coarse, "coarse", F.format_string("SDZ %.0fs no-anchor", "span")),
    )


def long_policy(windows: DataFrame, read: Reader, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, boundary_id, cut_t, method, detail) of dead zones: a coarse pass, then a dense one where the coarse one says.

    That is between the readings that bracket the change, or behind the last coarse one if all are old, or nowhere.
    """
    coarse = judged(read(coarse_requests(windows)), settings)
    changed = F.col("first_new").isNotNull()
    spans = with_transition(coarse).where("any_ocr").groupBy(*KEY, *_CARRIED).agg(F.first("last_old").alias("last_old"), F.first("first_new").alias("first_new"), F.max("t").alias("last"))
    low = F.when(changed, F.greatest(F.floor("last_old").cast("int"), F.col("lo"))).otherwise(F.col("last") + 1)
    high = F.when(changed, F.floor("first_new").cast("int")).otherwise(F.col("hi"))
    spans = spans.withColumns({"__low": low, "__high": high}).where("__low <= __high")
    dense = spans.select(*KEY, *_CARRIED, "last", F.explode(F.sequence("__low", "__high")).alias("t"))
    unread = ((F.col("t") - F.col("lo")) % _step() != 0) | (F.col("t") > F.col("last"))
    fine = judged(read(dense.where(unread).drop("last")), settings)
    # Dealt out anew: both sides are by boundary already, but their partitions need not match once they were coalesced.
    own = with_transition(coarse.unionByName(fine).repartition(*KEY)).withColumns({"upper": F.col("first_new"), "upper_dt": F.col("new_dt")})
    return _result(
        _gap(own),
        (changed, placed(), "ocr", F.lit("")),
        (F.col("any_ocr"), F.col("video_t"), "coarse", F.lit("all-old-in-window")),
        (F.lit(True), F.col("video_t"), "coarse", F.format_string("LDZ %.0fs", "span")),
    )


#: A policy: from windows, a reader, events or None, and settings to (tape_id, boundary_id, cut_t, method, detail).
Policy = Callable[[DataFrame, Reader, DataFrame | None, Settings], DataFrame]
POLICIES: dict[str, Policy] = {}


def register_policy(name: str, policy: Policy) -> None:
    """Makes a policy known by a name that refine takes; an earlier one of that name is replaced."""
    POLICIES[name] = policy


def coarse_policy(windows: DataFrame, read: Reader, events: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The boundaries where they are, without any reading."""
    return _result(windows, (F.lit(True), F.col("video_t"), "coarse", F.lit("")))


register_policy("short", short_policy)
register_policy("long", lambda windows, read, events, settings: long_policy(windows, read, settings))
register_policy("coarse", coarse_policy)

#: What a placement by a table function gets of each reading, in the order of t.
PLACED = "tape_id STRING, boundary_id BIGINT, cut_t DOUBLE, method STRING, detail STRING"


def placement(place: Callable[[list[dict]], tuple[float, str, str]]):
    """A Python table function of judged readings, PARTITION BY (tape_id, boundary_id) ORDER BY t: one row for each boundary.

    place gets a boundary's readings, as dicts of all columns in the order of t, and returns (cut_t, method, detail). It is for rules
    that expressions can't state; a boundary's readings are the seconds of its window.
    """

    class Placement:
        def __init__(self) -> None:
            self.rows: list[dict] = []

        def eval(self, row) -> None:
            self.rows.append(row.asDict())

        def terminate(self):
            if self.rows:
                cut, method, detail = place(self.rows)
                yield self.rows[0]["tape_id"], self.rows[0]["boundary_id"], float(cut), method, detail

    return F.udtf(Placement, returnType=PLACED)


def placing_policy(place: Callable[[list[dict]], tuple[float, str, str]]) -> Policy:
    """A policy that reads every second of a window and places the cut by a Python function; windows without a reading stay where they are."""
    function = placement(place)

    def policy(windows: DataFrame, read: Reader, events: DataFrame | None, settings: Settings) -> DataFrame:
        own = judged(read(dense_requests(windows)), settings)
        return function(own.asTable().partitionBy(*KEY).orderBy("t"))

    return policy


def refine(found: DataFrame, read: Reader, events: DataFrame | None = None, settings: Settings = DEFAULTS, short: str = "short", long: str = "long") -> DataFrame:
    """(tape_id, boundary_id, cut_t, method, detail) of boundaries: by the policy that their span asks for, named short or long."""
    windows = windowed(found, settings)
    known, empty = F.col("prev_t").isNotNull() & F.col("prev_dt").isNotNull(), F.col("hi") < F.col("lo")
    unread = _result(windows.where(~known | empty), (~known, F.col("video_t"), "coarse", F.lit("no-prev")), (F.lit(True), F.col("video_t"), "coarse", F.lit("empty-window")))
    usable = windows.where(known & ~empty)
    placed_short = POLICIES[short](usable.where(F.col("span") < settings.dead_zone), read, events, settings)
    return unread.unionByName(placed_short).unionByName(POLICIES[long](usable.where(F.col("span") >= settings.dead_zone), read, events, settings))


def snap(refined: DataFrame, scene_cuts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """refined (tape_id, boundary_id, cut_t, prev_t, …) with snapped_t and snap_offset (null: none): to the end of a burst of scene cuts around, else to a cut just before."""
    t = F.col("cut_t")
    low = F.greatest(F.lit(0.0), t - settings.snap_context)
    cuts = scene_cuts.select("tape_id", "t")
    out = asof(asof(refined, cuts, "cut_t", "t", "__b"), cuts, "cut_t", "t", "__a", forward=True, strict=True)
    before, after = F.col("__b.t"), F.col("__a.t")

    def within(reach: float) -> Column:
        return before >= F.greatest(low, t - reach, F.coalesce("prev_t", low))

    burst = within(settings.snap_burst_accept) & (after <= t + settings.snap_after) & (after - before <= settings.snap_burst_most)
    to = F.when(burst, after).when(within(settings.snap_accept), before)
    return out.withColumn("snapped_t", F.coalesce(to, t)).withColumn("snap_offset", to - t).drop("__a", "__b")
