"""As-of joins along a tape by one sort and one window, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, at: str, right_at: str, name: str, forward: bool = False, strict: bool = False, key: str = "tape_id") -> DataFrame:
    """left with a struct column `name`: right's row nearest at or before left's `at` (forward: at or after; strict: not at it); null without one.

    Of several right rows at that position the one whose columns are greatest in their order is taken; rows of left
    with a null position get null, right ones are dropped; repeated rows of left each get theirs.
    """
    own, other = left.columns, [c for c in right.columns if c != key]
    left_type = left.select(F.struct(*own).alias("s")).schema["s"].dataType.simpleString()
    right_type = right.select(F.struct(*other).alias("s")).schema["s"].dataType.simpleString()
    lefts = left.select(F.col(key).alias("__key"), F.col(at).cast("double").alias("__at"), F.lit(0).alias("__right"), F.struct(*own).alias("__l"), F.lit(None).cast(right_type).alias("__r"))
    rights = right.where(F.col(right_at).isNotNull()).select(F.col(key).alias("__key"), F.col(right_at).cast("double").alias("__at"), F.lit(1).alias("__right"), F.lit(None).cast(left_type).alias("__l"), F.struct(*other).alias("__r"))
    place = F.desc("__at") if forward else F.asc("__at")
    tie = F.asc("__right") if strict else F.desc("__right")
    seen = Window.partitionBy("__key").orderBy(place, tie, "__r").rowsBetween(Window.unboundedPreceding, 0)
    # Dealt out anew: both sides may be by key already, in partitions that don't match once they were coalesced.
    found = lefts.unionByName(rights).repartition("__key").withColumn("__m", F.when(F.col("__at").isNotNull(), F.last("__r", ignorenulls=True).over(seen)))
    return found.where("__right = 0").select("__l.*", F.col("__m").alias(name))
