"""Boundaries between clocks, and cuts: detection, fusion with visual events, grouping, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.values import seconds
from tidemark.operators.sample import by_time
from tidemark.sources.shared import written


def boundaries(filtered: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tape_id, boundary_id, video_t, type, cam_before, cam_after, cam_jump_s, prev_t, prev_dt) between successive dated rows whose clocks jump."""
    pairs = filtered.select("tape_id", "video_t", "cam_ts", F.lag("video_t").over(by_time()).alias("prev_t"), F.lag("cam_ts").over(by_time()).alias("prev_dt"))
    jump, moved = seconds(F.col("prev_dt"), F.col("cam_ts")), F.col("video_t") - F.col("prev_t")
    pairs = pairs.withColumn("cam_jump_s", jump).withColumn("moved", moved)
    back = F.col("cam_jump_s") < settings.backward
    found = pairs.where((F.col("cam_jump_s") > F.col("moved") + settings.least_gap) | back)
    large = (F.col("cam_jump_s") > F.col("moved") + settings.large_gap) | back
    return found.select(
        "tape_id",
        F.row_number().over(by_time()).cast("bigint").alias("boundary_id"),
        "video_t",
        F.when(large, "large_gap").otherwise("gap").alias("type"),
        F.col("prev_dt").alias("cam_before"),
        F.col("cam_ts").alias("cam_after"),
        "cam_jump_s",
        "prev_t",
        "prev_dt",
    )


def fuse(found: DataFrame, events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Boundaries with a visual event (tape_id, t) from fuse_window before their last reading to fuse_window after them, both ends included.

    Events are dealt into bins of time, each boundary to the bins that its span touches, so the join is by key.
    """
    w, width = settings.fuse_window, 60.0
    low = F.coalesce(F.col("prev_t"), F.col("video_t") - w) - w
    spans = found.withColumn("__low", low).withColumn("__high", F.col("video_t") + w)
    bins = F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))
    spans = spans.withColumn("__bin", F.explode(bins))
    binned = events.select("tape_id", F.col("t").alias("__t"), F.floor(F.col("t") / width).alias("__bin")).distinct()
    hits = spans.join(binned, ["tape_id", "__bin"]).where(F.col("__t").between(F.col("__low"), F.col("__high"))).select("tape_id", "boundary_id").distinct()
    return found.join(hits, ["tape_id", "boundary_id"], "left_semi")


def chosen(found: DataFrame, mode: str) -> DataFrame:
    """The boundaries at which a mode cuts: all, large gaps, or changes of the date; none for an unknown mode."""
    rule = {"scene": F.lit(True), "session": F.col("type") == "large_gap", "daily": F.to_date("cam_before") != F.to_date("cam_after")}.get(mode, F.lit(False))
    return found.where(F.coalesce(rule, F.lit(False)))


def group_cuts(found: DataFrame, tapes: DataFrame, mode: str) -> DataFrame:
    """(tape_id, cut_t, boundary_id): the mode's cuts, after 0.0 for every tape."""
    own = chosen(found, mode).select("tape_id", F.col("video_t").alias("cut_t"), "boundary_id")
    return tapes.select("tape_id", F.lit(0.0).alias("cut_t"), F.lit(None).cast("bigint").alias("boundary_id")).unionByName(own)


def merge_short(cuts: DataFrame, least: float) -> DataFrame:
    """Cuts (tape_id, cut_t, boundary_id) of which each stands at least `least` after the last one kept; the first stays.

    Cuts come in the order of their boundaries, so one that a refinement moved before its predecessor is dropped. What
    is kept depends on what was kept before: one fold over a tape's cuts.
    """
    kind = cuts.select("cut_t", "boundary_id").schema
    item = F.struct(F.coalesce("boundary_id", F.lit(-1)).alias("o"), "cut_t", "boundary_id")
    row = f"array<struct<cut_t: {kind['cut_t'].dataType.simpleString()}, boundary_id: bigint>>"
    per_tape = cuts.repartition("tape_id").groupBy("tape_id").agg(F.array_sort(F.collect_list(item)).alias("cuts"))
    kept = F.aggregate(
        "cuts",
        F.array().cast(row),
        lambda kept, c: F.when((F.size(kept) == 0) | (c["cut_t"] - F.element_at(kept, -1)["cut_t"] >= least), F.concat(kept, F.array(F.struct(c["cut_t"].alias("cut_t"), c["boundary_id"].alias("boundary_id"))))).otherwise(kept),
    )
    return per_tape.select("tape_id", F.explode(kept).alias("c")).select("tape_id", "c.cut_t", "c.boundary_id")


def suppress_orphans(cuts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cuts (tape_id, cut_t, garbled, …), distinct in a tape, without pairs of garbled neighbours closer than orphan_gap.

    Pairs are taken from the left; in a chain of such neighbours all go, but the last of an odd number.
    """
    return _without_pairs(cuts, ["cut_t"], settings).where("NOT __paired").drop("__paired")


def _without_pairs(cuts: DataFrame, order: list[str], settings: Settings, second: bool = False) -> DataFrame:
    """cuts with __paired: whether a pair of neighbours in the order takes the cut away; second asks for __second: whether as the later one."""
    along = Window.partitionBy("tape_id").orderBy(*order)
    linked = F.col("garbled") & F.lag("garbled").over(along) & (F.col("cut_t") - F.lag("cut_t").over(along) < settings.orphan_gap)
    marked = cuts.withColumn("__link", F.coalesce(linked, F.lit(False))).withColumn("__chain", F.count(F.when(~F.col("__link"), 1)).over(along))
    chain = Window.partitionBy("tape_id", "__chain")
    marked = marked.withColumn("__n", F.count("*").over(chain)).withColumn("__k", F.row_number().over(chain.orderBy(*order)))
    marked = marked.withColumn("__paired", F.col("__k") <= 2 * F.floor(F.col("__n") / 2))
    if second:
        marked = marked.withColumn("__second", F.col("__paired") & (F.col("__k") % 2 == 0))
    return marked.drop("__link", "__chain", "__n", "__k")


def suppress_listed_orphans(cuts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Of cuts (tape_id, boundary_id, cut_t, garbled, …) in the order of their boundaries, which may coincide or go back, those that no pair takes away.

    A position is garbled if one of its boundaries is. Pairs are taken along the list, also of coinciding cuts; from
    then on a position that a pair took is garbled no more, wherever it comes again. That is repeated until no pair is
    left: mostly once, since cuts in order leave none behind.
    """
    at = Window.partitionBy("tape_id", "cut_t")
    before = at.orderBy("boundary_id").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("tape_id").orderBy("boundary_id")
    cuts = cuts.withColumn("__g", F.max("garbled").over(at))
    while True:
        own = cuts.withColumn("garbled", F.col("__g"))
        while True:
            own = _without_pairs(own, ["boundary_id"], settings, second=True)
            # Taken before: by an earlier pair, not by the one that this cut is the second of.
            with_last = F.col("__second") & F.coalesce(F.lag("cut_t").over(along) == F.col("cut_t"), F.lit(False))
            earlier = F.when(with_last, F.max("__paired").over(before.rowsBetween(Window.unboundedPreceding, -2))).otherwise(F.max("__paired").over(before))
            own = written(own.withColumn("__now", F.col("__g") & ~F.coalesce(earlier, F.lit(False))), "orphans")
            # What an earlier pair takes changes only what comes behind it, so marks settle from the front.
            if own.where("__now <> garbled").isEmpty():
                break
            own = own.withColumn("garbled", F.col("__now")).drop("__paired", "__second", "__now")
        if own.where("__paired").isEmpty():
            return own.drop("__g", "__paired", "__second", "__now")
        taken = F.max("__paired").over(at)
        cuts = own.withColumn("__g", F.col("__g") & ~taken).where("NOT __paired").drop("__paired", "__second", "__now")
