"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

A source's documents stand in the order of a hash, end to end as one stream of words, read again from its beginning
where the target exceeds it, and cut into blocks of `block_words` words; the last block ends at the target. Every
source gets as many slots of the schedule as its target has blocks. The mix visits its slots in the order of the base-2
van der Corput sequence: point k, its bits reversed, falls into one of the equal parts of the cumulative slots, and
that names the source. So each part of the mix, however short, has the sources near their shares, and none is ever
exhausted early. A slot's rank among its source's slots says which block it takes, and blocks meet slots in a join.

Everything is DataFrame expressions. No task has a whole source: streams are summed up in parts of about `part_rows`
rows from the parts' sums; sources are numbered across range partitions; slots are made in chunks; and a slot's rank is
counted without a window, as the number of its source's slots with a smaller reversed number, bit by bit.

Defined results: null texts have no words; documents without words are never taken; the null source comes last;
repeated rows are documents of their own; without any word all targets are 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


@dataclass(frozen=True)
class Config:
    #: Weights of the sources in the order of their names, again and again.
    weights: tuple[int, ...] = (1, 2, 3)
    #: How many times a source's size its target may be.
    most_epochs: int = 3
    block_words: int = 4096
    part_rows: int = 4096


@dataclass(frozen=True)
class Mixture:
    """rows: (row, id, size, source_size, target), one for each document; pieces: (slot, source, block, row, id, low, high), words low to high of a document, which the mix has in the order of slots."""

    rows: DataFrame
    pieces: DataFrame


def _running(df: DataFrame, what: str, order: list[str], value: str, name: str) -> DataFrame:
    """df, written, with `name`: the sum of value over the rows before, in an order without ties; sorted by ranges, so no task has all rows."""
    split = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialise(split, what).withColumn("__part", F.shiftrightunsigned("__at", 33))
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the sort.
    parts = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = parts.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
    out = rows.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.join(before, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before", "__at")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, config: Config = Config()) -> DataFrame:
    """(source, no, source_size, target, words) of (source, size), written: no counts sources from 0, words is the target's whole part.

    The excess over most_epochs times a source's size is shared again among the others by weight, until no source is
    above; each round is one sum over the table of sources.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"unnamed": F.col("source").isNull(), "one": F.lit(1).cast("bigint")})
    named = _running(own, "sources", ["unnamed", "source"], "one", "no")
    w, kinds = F.lit(config.weights[-1]), len(config.weights)
    for k, x in enumerate(config.weights[:-1]):
        w = F.when(F.col("no") % kinds == k, x).otherwise(w)
    named = materialise(named.select("source", "no", "source_size", w.cast("bigint").alias("w"), (config.most_epochs * F.col("source_size")).alias("most")), "weights")
    total = named.agg(F.sum("source_size")).first()[0] or 0
    # Sources are capped in the order of most / w, so those of a round are the ones below the last share.
    share, weight, capped = total, 1, F.lit(False)
    while True:
        taken, free = named.agg(F.sum(F.when(capped, F.col("most")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("w")))).first()
        share, weight = total - (taken or 0), free or 1
        above = F.col("most") * weight < F.col("w") * share
        if named.where(~capped & above).isEmpty():
            break
        capped = capped | above
    exact = F.col("w") * F.lit(share).cast("bigint")
    target = F.when(capped, F.col("most").cast("double")).otherwise(exact / F.lit(weight))
    words = F.when(capped, F.col("most")).otherwise(F.expr(f"(w * {share}L) div {weight}L"))
    return materialise(named.select("source", "no", "source_size", target.alias("target"), words.cast("bigint").alias("words")), "targets")


def _reversed(v: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), bits, "0")), 2, 10).cast("bigint") if bits else F.lit(0).cast("bigint")


def _rank(v: Column, first: Column, n: Column, bits: int) -> Column:
    """How many of first, first + 1, … (n of them) have a smaller reversed number than v: those that agree with v in the bits below one where v has 1 and they have 0."""

    def term(j: int) -> Column:
        rest, size = v.bitwiseAND(F.lit((1 << j) - 1)), 1 << (j + 1)
        upto = lambda x: F.shiftright(x - rest + F.lit(size - 1), j + 1)
        return F.when(v.bitwiseAND(F.lit(1 << j)) != 0, upto(first + n) - upto(first)).otherwise(0)

    return functools.reduce(operator.add, [term(j) for j in range(bits)], F.lit(0).cast("bigint"))


def schedule(of: DataFrame, config: Config = Config(), chunk: int = 4096) -> DataFrame:
    """(slot, no, block) of targets (no, words): the slots in the order of the mix, and the block of its source that each takes."""
    own = of.select("no", F.ceil(F.col("words") / F.lit(config.block_words)).cast("bigint").alias("n")).where("n > 0")
    own = materialise(_running(own, "blocks", ["no"], "n", "first"), "slots")
    total = own.agg(F.sum("n")).first()[0] or 0
    bits = max(0, total - 1).bit_length()
    chunks = own.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {chunk}"))).alias("c")).repartition("no", "c")
    last = F.least(F.col("n") - 1, (F.col("c") + 1) * chunk - 1)
    v = chunks.select("no", "n", "first", F.explode(F.sequence(F.col("first") + F.col("c") * chunk, F.col("first") + last)).alias("v"))
    return v.select(_reversed(F.col("v"), bits).alias("slot"), "no", _rank(F.col("v"), F.col("first"), F.col("n"), bits).alias("block"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", config: Config = Config()) -> Mixture:
    """The mix of docs, whose tables are written."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    light = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), key.alias("h"))
    sizes = materialise(light, "sizes")
    of = targets(sizes, config)
    # The stream of a source: parts are ranges of the hash, so they are in order.
    parts = max(1, math.ceil(sizes.count() / config.part_rows))
    part = F.shiftright(F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint") * parts, 28)
    joined = sizes.join(of.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select("row", "id", "no", "size", "h", "source_size", "target", "words", part.alias("part"))
    inside = Window.partitionBy("no", "part").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = joined.groupBy("no", "part").agg(F.sum("size").alias("n"))
    before = sums.select("no", "part", (F.sum("n").over(Window.partitionBy("no").orderBy("part")) - F.col("n")).alias("before"))
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = materialise(joined.withColumn("start", start).join(before, ["no", "part"]).withColumn("start", F.col("start") + F.col("before")).select("row", "id", "no", "size", "source_size", "target", "words", "start"), "streams")
    # A document's words in the stream, once for each time that the source is read.
    low = lambda e: e * F.col("source_size") + F.col("start")
    spans = F.transform(F.sequence(F.lit(0), F.lit(config.most_epochs - 1)), lambda e: F.struct(low(e).alias("zero"), F.least(low(e) + F.col("size"), F.col("words")).alias("end")))
    spans = placed.select("row", "id", "no", F.explode(F.filter(spans, lambda s: s["zero"] < s["end"])).alias("s"))
    b = config.block_words
    cut = spans.select("row", "id", "no", "s", F.explode(F.sequence(F.expr(f"s.zero div {b}"), F.expr(f"(s.end - 1) div {b}"))).alias("block"))
    cut = cut.select("row", "id", "no", "block", (F.greatest("s.zero", F.col("block") * b) - F.col("s.zero")).alias("low"), (F.least("s.end", (F.col("block") + 1) * b) - F.col("s.zero")).alias("high"))
    pieces = cut.join(schedule(of, config), ["no", "block"]).select("slot", F.col("no").alias("source"), "block", "row", "id", "low", "high")
    return Mixture(placed.select("row", "id", "size", "source_size", "target"), pieces)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", config: Config = Config()) -> DataFrame:
    """(id, size, source_size, target, taken): how many of its words the mix takes of each document, repeats counted."""
    m = mixture(docs, id_col, text_col, source_col, config)
    facts = ["id", "size", "source_size", "target"]
    own = m.rows.select("row", *facts, F.lit(0).cast("bigint").alias("taken"))
    got = m.pieces.select("row", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in facts], (F.col("high") - F.col("low")).alias("taken"))
    merged = own.unionByName(got).groupBy("row").agg(*[F.max(c).alias(c) for c in facts], F.sum("taken").alias("taken"))
    return merged.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
