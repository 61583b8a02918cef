"""Cleaning of dated samples (tape_id, video_t, cam_ts, …): misread dates and clocks are dropped, rows without a date stay unless said otherwise.

Neighbours are found by windows over a tape in one order, that of by_time(), so that a tape is sorted once for all rules;
every decision is taken on the operator's input. Repeated rows are neighbours of each other; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.values import clock, confusable_months
from tidemark.operators.sample import ORDER, by_time


def _nearest(column: str, move: str) -> Column:
    """The value of the nearest row before (lag) or after (lead) that has one."""
    return F.expr(f"{move}({column}) IGNORE NULLS OVER (PARTITION BY tape_id ORDER BY {ORDER})")


def _with_neighbours(samples: DataFrame) -> DataFrame:
    """samples with their date __d, and the dates __p and __n of the dated rows before and after."""
    return samples.withColumn("__d", F.to_date("cam_ts")).withColumns({"__p": _nearest("__d", "lag"), "__n": _nearest("__d", "lead")})


def drop_date_islands(samples: DataFrame) -> DataFrame:
    """Without dated rows whose date is neither that of the dated row before nor of the one after; the first and last stay."""
    island = F.col("__d").isNotNull() & (F.col("__d") != F.col("__p")) & (F.col("__d") != F.col("__n"))
    return _with_neighbours(samples).where(~F.coalesce(island, F.lit(False))).drop("__d", "__p", "__n")


def _between_equal_runs(samples: DataFrame, misread: Column) -> DataFrame:
    """Without rows of runs of one date (__d) that stand between two runs of one other date (__l, __r) and are misread."""
    marked = _with_neighbours(samples).withColumns({"__x": F.when(F.col("__d") != F.col("__p"), F.col("__p")), "__y": F.when(F.col("__d") != F.col("__n"), F.col("__n"))})
    # A run's outer dates are known where it begins and ends; they are carried to its other rows.
    marked = marked.withColumns({"__l": F.coalesce("__x", _nearest("__x", "lag")), "__r": F.coalesce("__y", _nearest("__y", "lead"))})
    dropped = F.col("__d").isNotNull() & (F.col("__l") == F.col("__r")) & misread
    return marked.where(~F.coalesce(dropped, F.lit(False))).drop("__d", "__p", "__n", "__x", "__y", "__l", "__r")


def drop_digit_runs(samples: DataFrame) -> DataFrame:
    """Without runs that lost a digit of the day: month and year of the dates around them, and one digit of their day."""
    d, outer = F.col("__d"), F.col("__l")
    day = F.day(outer)
    return _between_equal_runs(samples, (F.trunc(d, "month") == F.trunc(outer, "month")) & (day >= 10) & ((F.day(d) == day % 10) | (F.day(d) == F.floor(day / 10))))


def drop_month_runs(samples: DataFrame) -> DataFrame:
    """Without runs whose month was confused: day and year of the dates around them, and a month that looks like theirs."""
    d, outer = F.col("__d"), F.col("__l")
    return _between_equal_runs(samples, (F.day(d) == F.day(outer)) & (F.year(d) == F.year(outer)) & confusable_months(F.month(d), F.month(outer)))


def drop_year_runs(samples: DataFrame) -> DataFrame:
    """Without runs of a misread year: from a run, those of its month and other years up to the next of its month and year.

    The walk goes on behind that next run, so it is a true recursion. It never leaves a stretch of successive runs of one
    month, and takes each stretch's first run, so it is folded over the runs of a stretch, which are few.
    """
    dated = F.col("__d").isNotNull()
    marked = samples.withColumn("__d", F.to_date("cam_ts")).withColumn("__p", _nearest("__d", "lag"))
    changed = lambda f: F.count(F.when(dated & (F.col("__p").isNull() | (f("__d") != f("__p"))), 1)).over(by_time())
    marked = marked.withColumns({"__run": F.when(dated, changed(F.col)), "__stretch": F.when(dated, changed(F.month))})
    runs = marked.where(dated).groupBy("tape_id", "__stretch", F.col("__run").alias("i")).agg(F.year(F.min("__d")).alias("y"))
    following = F.lead("i").over(Window.partitionBy("tape_id", "__stretch", "y").orderBy("i"))
    runs = runs.withColumn("nx", F.coalesce(following, F.col("i") + 1))
    jumps = "array<struct<low: bigint, high: bigint>>"

    def step(state: Column, run: Column) -> Column:
        here = state["at"] == run["i"]
        found = F.concat(state["out"], F.array(F.struct((run["i"] + 1).alias("low"), (run["nx"] - 1).alias("high"))))
        return F.struct(F.when(here, run["nx"]).otherwise(state["at"]).alias("at"), F.when(here & (run["nx"] > run["i"] + 1), found).otherwise(state["out"]).alias("out"))

    per_stretch = runs.groupBy("tape_id", "__stretch").agg(F.array_sort(F.collect_list(F.struct("i", "nx"))).alias("runs"), F.max(F.col("nx") - F.col("i")).alias("far")).where("far > 1")
    start = F.struct(F.element_at("runs", 1)["i"].alias("at"), F.array().cast(jumps).alias("out"))
    walked = per_stretch.select("tape_id", "__stretch", F.explode(F.aggregate("runs", start, step, lambda s: s["out"])).alias("j"))
    dropped = walked.select("tape_id", F.explode(F.sequence("j.low", "j.high")).alias("__run"))
    return marked.join(dropped, ["tape_id", "__run"], "left_anti").select(*samples.columns)


def drop_outliers(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Dated rows only, without readings that agree with no neighbour within most_run + 1 steps while some before agrees with some after.

    Two readings agree if their clocks minus their positions are less than most_drift apart.
    """
    reach = [k for k in range(1, settings.most_run + 2)]
    out = samples.where("cam_ts IS NOT NULL").withColumn("__0", clock(F.col("cam_ts")) - F.col("video_t"))
    out = out.withColumns({f"__{side}{k}": move("__0", k).over(by_time()) for k in reach for side, move in (("b", F.lag), ("a", F.lead))})

    def agree(one: str, other: str) -> Column:
        return F.coalesce(F.abs(F.col(one) - F.col(other)) < settings.most_drift, F.lit(False))

    either = lambda tests: functools.reduce(operator.or_, tests)
    near = either(agree(f"__{side}{k}", "__0") for k in reach for side in "ba")
    bridge = either(agree(f"__b{k}", f"__a{j}") for k in reach for j in reach)
    edge = F.col("__b1").isNull() | F.col("__a1").isNull()
    return out.where(edge | near | ~bridge).select(*samples.columns)


def clean(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All rules, in the order in which each sees the last one's output."""
    return drop_outliers(drop_month_runs(drop_digit_runs(drop_year_runs(drop_date_islands(samples)))), settings)
