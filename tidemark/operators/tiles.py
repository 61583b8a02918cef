"""Tapes in tiles: the rules of a tape over stretches of bounded length, so that a long tape is many tasks.

A tile is `tile_s` seconds of a tape. Every rule looks at neighbours that may lie any distance away, so tiles are worked
on in two levels. Each tile sends its outermost rows, a handful, to a table of borders; windows over that table, which
has a few rows for each tile, find what the rows nearest before and after each tile are. These are added to the tile's
own rows, the rule runs on each tile as if it were a tape, and the added rows are taken out again. What must be carried
further, as numbers and sums, is added up over the same table. Rows at one position are in one tile.

Each step's output is a written table, since two levels read it twice. The results are those of the rules on whole tapes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.values import clock
from tidemark.operators import clean, label, sample, segment
from tidemark.operators.walk import BLOCK, walked
from tidemark.sources.shared import written

#: The tile as a tape: its name is the tape's and the tile's.
_MARK = "#"


def tile_of(t: Column, settings: Settings = DEFAULTS) -> Column:
    return F.floor(t / settings.tile_s).cast("bigint")


def tiled(df: DataFrame, at: str = "video_t", settings: Settings = DEFAULTS) -> DataFrame:
    """df with its tile."""
    return df.withColumn("tile", tile_of(F.col(at), settings))


def _as_tape(df: DataFrame) -> DataFrame:
    return df.withColumn("tape_id", F.concat("tape_id", F.lit(_MARK), F.col("tile").cast("string")))


def _as_tile(df: DataFrame) -> DataFrame:
    """The tape and tile of rows that were worked on as a tape's."""
    own = F.element_at(F.split("tape_id", _MARK), -1)
    return df.withColumn("tile", own.cast("bigint")).withColumn("tape_id", F.expr(f"substr(tape_id, 1, length(tape_id) - length(substring_index(tape_id, '{_MARK}', -1)) - 1)"))


# --- borders ---


def _before(df: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """df, one row for each tile, with before: the sum of n over the rows of `by` before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def neighbours(rows: DataFrame, tiles: DataFrame, order: list[str], k: int, back: bool) -> DataFrame:
    """The k rows nearest before (back) or behind each of tiles (tape_id, tile), of rows (tape_id, tile, …), with the tile's number as tile."""
    turn = F.desc if back else F.asc
    inner = Window.partitionBy("tape_id", "tile").orderBy(*[turn(c) for c in order])
    edge = rows.withColumn("__k", F.row_number().over(inner)).where(F.col("__k") <= k)
    # Numbers of edge rows along the tape, away from it if back: a tile's neighbours are the next k behind its own.
    per_tile = edge.groupBy("tape_id", "tile").agg(F.count("*").alias("__n"))
    along = F.when(F.lit(back), -F.col("tile")).otherwise(F.col("tile"))
    counts = tiles.select("tape_id", "tile").distinct().join(per_tile, ["tape_id", "tile"], "full").withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn("__o", along)
    counts = written(_before(counts, ["tape_id"], "__o", "__n"), "borders")
    numbered = edge.join(counts.select("tape_id", "tile", "before"), ["tape_id", "tile"]).withColumn("__g", F.col("before") + F.col("__k")).drop("before", "__k", "tile")
    # Rows nearest to a tile are those of the tiles that follow it in this order.
    wanted = counts.select("tape_id", "tile", F.explode(F.sequence(F.col("before") + F.col("__n") + 1, F.col("before") + F.col("__n") + k)).alias("__g"))
    return wanted.join(numbered, ["tape_id", "__g"]).drop("__g")


def neighbour_runs(rows: DataFrame, tiles: DataFrame, order: list[str], value: Column, back: bool) -> DataFrame:
    """The row nearest before or behind each tile, and the nearest beyond it that has another value."""
    own = rows.withColumn("__v", value)
    turn = F.desc if back else F.asc
    inner = Window.partitionBy("tape_id", "tile").orderBy(*[turn(c) for c in order])
    # A tile's first two values from that side, each by its first row; these are put in one row to be carried as one.
    new = F.coalesce(F.lag("__v").over(inner) != F.col("__v"), F.lit(True))
    first = own.withColumn("__new", new).where("__new").withColumn("__k", F.row_number().over(inner)).where("__k <= 2").drop("__new", "__k")
    along = Window.partitionBy("tape_id").orderBy(*[(F.asc if back else F.desc)(c) for c in ["tile", *order]])
    kept = [c for c in first.columns if c not in ("tape_id", "tile", "__v")]
    row = F.struct(*kept)
    # Beyond a row, seen from the tile: the row before it in this order if it has another value, else what is beyond that one.
    beyond = F.when(F.lag("__v").over(along) != F.col("__v"), F.lag(row).over(along))
    far = first.withColumn("__row", row).withColumn("__far", beyond)
    far = far.withColumn("__far", F.last("__far", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    near = neighbours(far.select("tape_id", "tile", *order, "__row", "__far"), tiles, order, 1, back)
    return near.select("tape_id", "tile", F.explode(F.array_compact(F.array("__row", "__far"))).alias("r")).select("tape_id", "tile", "r.*")


def in_tiles(rows: DataFrame, added: list[DataFrame], rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rule over each tile of rows and the rows added to it, without the added ones; rule keeps the columns of rows."""
    whole = rows.withColumn("__added", F.lit(False))
    for a in added:
        whole = whole.unionByName(a.withColumn("__added", F.lit(True)), allowMissingColumns=True)
    return _as_tile(rule(_as_tape(whole).drop("tile"))).where("NOT __added").drop("__added").select(*rows.columns)


def _tiles(rows: DataFrame) -> DataFrame:
    return rows.select("tape_id", "tile").distinct()


ORDER = ["video_t", "cam_ts"]


# --- samples and cleaning ---


def fill_time_only(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As sample.fill_time_only, of samples (tape_id, tile, video_t, cam_ts, minute, …).

    A tile needs the last reading with a time before it, with its date: that of the last dated reading, or of the tape's
    first one if none came before, and as many days more as midnights passed since, which is a sum over tiles.
    """
    dated, timed = F.col("cam_ts").isNotNull(), F.col("cam_ts").isNull() & F.col("minute").isNotNull()
    inside = Window.partitionBy("tape_id", "tile").orderBy(*ORDER)
    own = samples.where(dated | timed).withColumn("__m", F.when(dated, F.hour("cam_ts") * 60 + F.minute("cam_ts")).otherwise(F.col("minute")))
    wrap = F.coalesce(timed & (F.col("__m") < F.lag("__m").over(inside) - settings.wrap_minutes), F.lit(False)).cast("int")
    own = own.withColumn("__w", wrap).withColumn("__since", F.count(F.when(dated, 1)).over(inside)).withColumn("__in", F.count(F.when(dated, 1)).over(Window.partitionBy("tape_id", "tile")))
    place = F.struct(*ORDER)
    border = own.groupBy("tape_id", "tile").agg(
        F.min_by(F.struct("__m", timed.alias("timed")), place).alias("first"),
        F.max_by("__m", place).alias("last"),
        F.max("video_t").alias("video_t"),
        F.max_by("cam_ts", F.when(dated, place)).alias("dated"),
        F.min_by("cam_ts", F.when(dated, place)).alias("first_dated"),
        F.sum("__w").alias("w"),
        F.sum(F.when(F.col("__since") == F.col("__in"), F.col("__w")).otherwise(0)).alias("w_since"),
    )
    along = Window.partitionBy("tape_id").orderBy("tile")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    at_border = (F.col("first.timed") & (F.col("first.__m") < F.lag("last").over(along) - settings.wrap_minutes)).cast("int")
    border = border.withColumn("w_all", F.col("w") + F.coalesce(at_border, F.lit(0)))
    # What a tile sends on: its own dated reading and the midnights since, or all that passed in it.
    border = border.withColumns({"segment": F.count("dated").over(along), "sent": F.when(F.col("dated").isNull(), F.col("w_all")).otherwise(F.col("w_since"))})
    anchor = F.coalesce(F.last("dated", ignorenulls=True).over(along), F.first("first_dated", ignorenulls=True).over(Window.partitionBy("tape_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    passed = F.sum("sent").over(Window.partitionBy("tape_id", "segment").orderBy("tile"))
    at = F.date_add(F.to_date(anchor), passed.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("last"))
    border = written(border.withColumn("cam_ts", at), "borders")
    tiles = _tiles(samples)
    last = neighbours(border.select("tape_id", "tile", "video_t", "cam_ts"), tiles, ["video_t"], 1, back=True)
    # Before all readings with a time: the tape's first dated one, put behind the tile.
    first = border.where("first_dated IS NOT NULL").groupBy("tape_id").agg(F.min_by("first_dated", "tile").alias("cam_ts"), F.lit(float("inf")).alias("video_t"))
    lead = tiles.join(last.select("tape_id", "tile"), ["tape_id", "tile"], "left_anti").join(first, "tape_id")
    return in_tiles(samples, [last, lead], lambda s: sample.fill_time_only(s, settings))


def _dated(samples: DataFrame) -> DataFrame:
    return samples.where("cam_ts IS NOT NULL").select("tape_id", "tile", *ORDER)


def _sides(rows: DataFrame, tiles: DataFrame, k: int) -> list[DataFrame]:
    return [neighbours(rows, tiles, ORDER, k, back) for back in (True, False)]


def _run_sides(rows: DataFrame, tiles: DataFrame) -> list[DataFrame]:
    return [neighbour_runs(rows, tiles, ORDER, F.to_date("cam_ts"), back) for back in (True, False)]


def drop_date_islands(samples: DataFrame) -> DataFrame:
    return in_tiles(samples, _sides(_dated(samples), _tiles(samples), 1), clean.drop_date_islands)


def drop_digit_runs(samples: DataFrame) -> DataFrame:
    return in_tiles(samples, _run_sides(_dated(samples), _tiles(samples)), clean.drop_digit_runs)


def drop_month_runs(samples: DataFrame) -> DataFrame:
    return in_tiles(samples, _run_sides(_dated(samples), _tiles(samples)), clean.drop_month_runs)


def drop_outliers(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return in_tiles(samples, _sides(_dated(samples), _tiles(samples), settings.most_run + 1), lambda s: clean.drop_outliers(s, settings))


def drop_year_runs(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """As clean.drop_year_runs: runs are numbered along the tape, and the walk over them goes along pointers to the next run of the month's stretch that has the same year."""
    day = F.to_date("cam_ts")
    own = samples.where("cam_ts IS NOT NULL").select("tape_id", "tile", *ORDER)
    before = neighbours(own, _tiles(samples), ORDER, 1, back=True).select("tape_id", "tile", F.to_date("cam_ts").alias("__q"))
    inside = Window.partitionBy("tape_id", "tile").orderBy(*ORDER)
    dated = F.col("cam_ts").isNotNull()
    prev = F.last(F.when(dated, day), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = samples.join(before, ["tape_id", "tile"], "left").withColumn("__p", F.coalesce(prev, "__q")).drop("__q")
    changed = lambda f: (dated & (F.col("__p").isNull() | (f(day) != f(F.col("__p"))))).cast("int")
    marked = marked.withColumns({"__r": changed(lambda c: c), "__s": changed(F.month)})
    marked = marked.withColumns({c: F.sum(c).over(inside) for c in ("__r", "__s")})
    sums = written(_before(_before(marked.groupBy("tape_id", "tile").agg(F.max("__r").alias("r"), F.max("__s").alias("s")), ["tape_id"], "tile", "r").withColumnRenamed("before", "br"), ["tape_id"], "tile", "s"), "run-numbers")
    marked = marked.join(sums.select("tape_id", "tile", "br", F.col("before").alias("bs")), ["tape_id", "tile"])
    marked = written(marked.withColumns({"__run": F.when(dated, F.col("__r") + F.col("br")), "__stretch": F.when(dated, F.col("__s") + F.col("bs"))}).drop("__p", "__r", "__s", "br", "bs"), "runs")
    runs = marked.where(dated).groupBy("tape_id", F.col("__run").alias("i")).agg(F.min("__stretch").alias("stretch"), F.year(F.min(day)).alias("y"))
    runs = written(runs.withColumn("tile", F.floor(F.col("i") / block)), "year-runs")
    # The next run of the year in the stretch: in the block of runs, else the first of a later block.
    by = ["tape_id", "stretch", "y"]
    later = runs.groupBy(*by, "tile").agg(F.min("i").alias("m")).withColumn("later", F.lead("m").over(Window.partitionBy(*by).orderBy("tile"))).drop("m")
    following = F.lead("i").over(Window.partitionBy(*by, "tile").orderBy("i"))
    runs = runs.withColumn("nx", following).join(later, [*by, "tile"]).withColumn("nx", F.coalesce("nx", "later"))
    # Runs are numbered without gaps; only a tape's last one has none behind it.
    last = runs.groupBy("tape_id").agg(F.max("i").alias("last"))
    nodes = written(runs.join(last, "tape_id").select("tape_id", "i", F.coalesce("nx", F.when(F.col("i") < F.col("last"), F.col("i") + 1)).alias("nx")), "year-pointers")
    jumps = walked(nodes, block).join(nodes, ["tape_id", "i"]).where("nx > i + 1")
    dropped = jumps.select("tape_id", F.explode(F.sequence(F.col("i") + 1, F.col("nx") - 1)).alias("__run"))
    return marked.join(dropped, ["tape_id", "__run"], "left_anti").select(*samples.columns)


def clean_tiles(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As clean.clean, of filled samples (tape_id, tile, video_t, cam_ts); each rule's output is written."""
    for name, rule in (("islands", drop_date_islands), ("years", drop_year_runs), ("digits", drop_digit_runs), ("months", drop_month_runs)):
        samples = written(rule(samples), name)
    return written(drop_outliers(samples, settings), "filtered")


# --- cuts and clips ---


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df (tape_id, tile, …) with the row's number along its tape, from 1."""
    inner = df.withColumn(name, F.row_number().over(Window.partitionBy("tape_id", "tile").orderBy(*order)))
    counts = written(_before(df.groupBy("tape_id", "tile").agg(F.count("*").alias("__n")), ["tape_id"], "tile", "__n"), "numbers")
    return inner.join(counts.select("tape_id", "tile", "before"), ["tape_id", "tile"]).withColumn(name, F.col(name) + F.col("before")).drop("before")


def boundaries(filtered: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As segment.boundaries, of filtered (tape_id, tile, video_t, cam_ts), with the tile."""
    before = neighbours(filtered, _tiles(filtered), ORDER, 1, back=True)
    found = _as_tile(segment.boundaries(_as_tape(filtered.unionByName(before)).drop("tile"), settings))
    found = written(found, "boundaries")
    return _numbered(found.drop("boundary_id"), ["video_t", "cam_after"], "boundary_id").select("tape_id", "tile", "boundary_id", *[c for c in found.columns if c not in ("tape_id", "tile", "boundary_id")])


def merge_short(cuts: DataFrame, least: float, settings: Settings = DEFAULTS, block: int = BLOCK) -> DataFrame:
    """As segment.merge_short, as a walk: from a cut kept the next one kept is the first that stands `least` or more behind it.

    A cut that stands before an earlier one of its tape is never kept, so the others are in order, and the next one is
    found by position.
    """
    kept = [c for c in cuts.columns]
    own = cuts.withColumns({"__o": F.coalesce("boundary_id", F.lit(-1)), "__c": F.floor(F.coalesce("boundary_id", F.lit(-1)) / block)})
    own = own.repartition("tape_id", "__c")
    inner = Window.partitionBy("tape_id", "__c").orderBy("__o", "cut_t").rowsBetween(Window.unboundedPreceding, -1)
    highest = own.groupBy("tape_id", "__c").agg(F.max("cut_t").alias("__h"))
    over = written(highest.withColumn("__h", F.max("__h").over(Window.partitionBy("tape_id").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))), "highest")
    own = own.withColumn("__m", F.max("cut_t").over(inner)).join(over, ["tape_id", "__c"]).where(F.coalesce(F.col("cut_t") >= F.greatest("__m", "__h"), F.lit(True)))
    own = own.drop("__c", "__m", "__h")
    if least <= 0:
        return own.select(*kept)
    own = written(_numbered(tiled(own.drop("tile"), "cut_t", settings), ["cut_t", "__o"], "i"), "cuts")
    asked = tiled(own.select("tape_id", "i", (F.col("cut_t") + least).alias("asked")), "asked", settings)
    at = own.select("tape_id", "tile", F.col("cut_t").alias("asked"), F.col("i").alias("nx"))
    behind = neighbours(at, _tiles(asked), ["asked", "nx"], 1, back=False)
    # In a tile: the first cut at or behind the place asked for.
    both = asked.withColumn("nx", F.lit(None).cast("bigint")).unionByName(at.unionByName(behind).withColumn("nx", F.col("nx").cast("bigint")).withColumn("i", F.lit(None).cast("bigint")))
    back = Window.partitionBy("tape_id", "tile").orderBy(F.desc("asked"), F.desc_nulls_last("nx")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = both.withColumn("nx", F.last("nx", ignorenulls=True).over(back)).where("i IS NOT NULL").select("tape_id", "i", "nx")
    return own.join(walked(nodes, block), ["tape_id", "i"], "left_semi").select(*kept)


def confirmed(filtered: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As label.confirmed, with the tile."""
    added = _sides(filtered.select("tape_id", "tile", *ORDER), _tiles(filtered), 1)
    return in_tiles(filtered.withColumn("confirmed", F.lit(None).cast("boolean")), added, lambda f: label.confirmed(f.drop("confirmed"), settings))


def clip_bounds(cuts: DataFrame, tapes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As label.clip_bounds, with the tile of the clip's start."""
    own = written(_numbered(tiled(cuts.select("tape_id", "cut_t", "boundary_id"), "cut_t", settings), ["cut_t"], "clip_no"), "cuts")
    behind = neighbours(own.select("tape_id", "tile", "cut_t"), _tiles(own), ["cut_t"], 1, back=False).select("tape_id", "tile", F.col("cut_t").alias("__end"))
    following = F.lead("cut_t").over(Window.partitionBy("tape_id", "tile").orderBy("cut_t"))
    out = own.withColumn("exact_end", following).join(behind, ["tape_id", "tile"], "left").withColumn("exact_end", F.coalesce("exact_end", "__end")).join(tapes.select("tape_id", "duration_s"), "tape_id")
    return out.select("tape_id", "tile", F.col("clip_no").cast("int").alias("clip_no"), F.col("cut_t").alias("start_t"), F.coalesce("exact_end", "duration_s").alias("end_t"), F.when(F.col("clip_no") > 1, F.col("cut_t")).alias("exact_start"), "exact_end", "boundary_id")


def labelled(clips: DataFrame, filtered: DataFrame, found: DataFrame, mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    """As label.labelled: of clips and filtered with their tiles, without them."""
    sure = written(confirmed(filtered, settings).where("confirmed").drop("confirmed"), "confirmed")
    tiles = _tiles(clips)
    sure_too = sure.unionByName(neighbour_runs(sure.select("tape_id", "tile", *ORDER), tiles.unionByName(_tiles(sure)).distinct(), ORDER, F.to_date("cam_ts"), back=False))
    rows = filtered.select("tape_id", "tile", *ORDER)
    rows = rows.unionByName(neighbours(rows, tiles, ORDER, 1, back=False))
    old = clips.join(found.select("tape_id", "boundary_id", F.to_date("cam_before").alias("__old")).hint("merge"), ["tape_id", "boundary_id"], "left")
    out = _as_tile(label.named(*[_as_tape(x).drop("tile") for x in (old, sure_too, rows)], mode))
    return out.select(*[c for c in clips.columns if c != "tile"], "label")


def dry_run(samples: DataFrame, tapes: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filtered, boundaries, clips) as plans.pipeline.dry_run has them, tile by tile."""
    parsed = written(tiled(sample.parsed(samples.select("tape_id", "video_t", "raw"), settings), settings=settings).drop("raw"), "parsed")
    filled = written(fill_time_only(parsed, settings).select("tape_id", "tile", *ORDER), "filled")
    filtered = clean_tiles(filled, settings)
    found = written(boundaries(filtered, settings), "boundaries")
    cuts = merge_short(segment.group_cuts(found, tapes, settings.mode), settings.clip_floor(), settings)
    clips = labelled(clip_bounds(cuts, tapes, settings), filtered, found, settings.mode, settings)
    return filtered.drop("tile"), found.drop("tile"), clips
