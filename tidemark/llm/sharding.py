"""Sharding by minimax contiguous partition.

Equal texts are one atomic group. Groups stand in the order of their text's 64-bit hash; a shard is a contiguous
run of them. The smallest capacity that `shards` greedy shards can keep is found by binary search; then the order
is cut within that capacity, as evenly as it allows.

The driver never holds all groups. It holds sums of hash ranges (`resolution` rows at most): with them a capacity
is surely feasible if a greedy pass that cuts at range borders succeeds, and surely not if a pass that may cut
anywhere inside a divisible range fails. Only the ranges that lie between the two answers are split further, by
more bits of the hash, in one aggregation each time, until both answers are the same. The result is exact.

Defined results: null and empty texts are one group of size `overhead` a row and checksum 0; repeated rows are rows
of their own; texts whose hashes collide share a group; with fewer groups than shards some shards are empty; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


@dataclass
class Ranges:
    """Hash ranges in order: lowest hash, bits of the hash that name it, sum of sizes, whether it holds one group only."""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    atomic: np.ndarray

    @property
    def prefix(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])


def _sums(rows: DataFrame, bits: int) -> Ranges:
    shift = 64 - bits
    got = rows.groupBy(F.shiftright("h", shift).alias("r")).agg(F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("atomic")).orderBy("r").toArrow()
    r = got.column("r").to_numpy().astype(np.int64)
    return Ranges(r << np.int64(shift), np.full(len(r), bits), got.column("size").to_numpy().astype(np.int64), got.column("atomic").to_numpy(zero_copy_only=False).astype(bool))


def _farthest(prefix: np.ndarray, i: int, capacity: int) -> int:
    return int(np.searchsorted(prefix, prefix[i] + capacity, side="right")) - 1


def _whole_ranges(prefix: np.ndarray, capacity: int, shards: int, i: int = 0) -> list[int]:
    """Borders that greedy shards reach if they cut at range borders only; the last is len(prefix) - 1 if they suffice."""
    out = []
    for _ in range(shards):
        i = _farthest(prefix, i, capacity)
        out.append(i)
    return out


def _any_cut(ranges: Ranges, prefix: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Positions that greedy shards reach if divisible ranges can be cut anywhere."""
    x, out = 0, []
    for _ in range(shards):
        x = min(x + capacity, int(prefix[-1]))
        k = int(np.searchsorted(prefix, x, side="right")) - 1
        if x < prefix[-1] and ranges.atomic[k]:
            x = int(prefix[k])
        out.append(x)
    return out


def _least(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _even_cuts(prefix: np.ndarray, capacity: int, shards: int) -> tuple[list[int], list[float]]:
    """Borders of shards within the capacity, each as near to its fair share of the rest as the capacity of the rest allows."""
    i, last, cuts, wanted = 0, len(prefix) - 1, [], []
    for left in range(shards, 1, -1):
        if i == last:
            break
        want = prefix[i] + (prefix[last] - prefix[i]) / left
        j = int(np.searchsorted(prefix, want))
        j -= bool(j - 1 > i and want - prefix[j - 1] < prefix[j] - want)
        most = _farthest(prefix, i, capacity)
        j = min(max(j, i + 1), most)
        if _whole_ranges(prefix, capacity, left - 1, j)[-1] < last:
            j = int(_least(lambda k: _whole_ranges(prefix, capacity, left - 1, k)[-1] == last, j, most))
        cuts.append(j)
        wanted.append(want)
        i = j
    return cuts, wanted


def cut_hashes(rows: DataFrame, shards: int, resolution: int = 1 << 17, first_bits: int = 12) -> tuple[list[int], int]:
    """The lowest hash of each shard but the first, and the smallest feasible capacity, of rows (h, size)."""
    ranges = _sums(rows, first_bits)
    if not len(ranges.size):
        return [], 0
    while True:
        prefix = ranges.prefix
        total, last = int(prefix[-1]), len(ranges.size)
        least = max(-(-total // shards), int(ranges.size[ranges.atomic].max(initial=0)))
        low = _least(lambda c: _any_cut(ranges, prefix, c, shards)[-1] == total, least, total)
        high = _least(lambda c: _whole_ranges(prefix, c, shards)[-1] == last, low, total)
        if low < high:
            spans = list(zip([int(prefix[i]) for i in _whole_ranges(prefix, low, shards)], _any_cut(ranges, prefix, high, shards)))
        else:
            cuts, wanted = _even_cuts(prefix, high, shards)
            spans = [(w, w) for w in wanted]
        split = np.zeros(last, bool)
        for a, b in spans:
            split[max(0, int(np.searchsorted(prefix, a, side="right")) - 1) : int(np.searchsorted(prefix, b, side="right"))] = True
        split &= ~ranges.atomic & (ranges.bits < 64)
        if low == high:
            split &= ranges.size > total / shards / 1000
        if not split.any():
            return [int(ranges.low[j]) for j in cuts if j < last], high
        ranges = _refined(rows, ranges, split, resolution)


def _refined(rows: DataFrame, ranges: Ranges, split: np.ndarray, resolution: int) -> Ranges:
    """ranges, those marked to split cut by more bits of the hash; as many as the resolution allows at once."""
    fewest = int(ranges.bits[split].min())
    split = split & (ranges.bits == fewest)
    bits = min(64, fewest + max(1, int(math.log2(max(2, (resolution - len(split)) / split.sum())))))
    # At most `resolution` numbers of ranges are broadcast.
    shift = 64 - fewest
    wanted = rows.sparkSession.createDataFrame(pa.table({"r": ranges.low[split] >> np.int64(shift)}))
    inside = rows.withColumn("r", F.shiftright("h", shift)).join(F.broadcast(wanted), "r", "left_semi")
    new = _sums(inside.select("h", "size"), bits)
    joined = [np.concatenate([getattr(ranges, k)[~split], getattr(new, k)]) for k in ("low", "bits", "size", "atomic")]
    order = np.argsort(joined[0], kind="stable")
    return Ranges(*[x[order] for x in joined])


def _light(docs: DataFrame, text: Column, overhead: int, *more: Column) -> DataFrame:
    return docs.select(*more, (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.xxhash64(text).alias("h"))


def _shard(h: Column, cuts: list[int]) -> Column:
    """How many of the cuts (one less than shards) a hash reaches."""
    return F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + (h >= c).cast("int")) if cuts else F.lit(0)


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, slot_rows: int = 4096) -> DataFrame:
    """(id, size, text_crc32, shard, slot): slot counts a shard's rows from 0 without gaps.

    Rows of a shard are numbered in parts of about slot_rows rows, each by its own task, from the parts' counts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).alias("u")
    rows = materialise(_light(docs, text, overhead, F.col(id_col), F.crc32(text.cast("binary")).alias("text_crc32"), spread), "sizes")
    cuts, _ = cut_hashes(rows.select("h", "size"), shards)
    parts = max(1, math.ceil(rows.count() / shards / slot_rows))
    placed = rows.withColumn("shard", _shard(F.col("h"), cuts)).withColumn("part", F.pmod("u", F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    first = counts.select("shard", "part", before.alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "u"))
    return placed.withColumn("k", number).join(first, ["shard", "part"]).select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("k") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, text_col: str = "text", overhead: int = 16) -> None:
    """docs as Parquet in one folder for each shard; a row's shard follows from its text, so nothing but hashes and sizes is shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cuts, _ = cut_hashes(materialise(_light(docs, text, overhead), "sizes"), shards)
    docs.withColumn("shard", _shard(F.xxhash64(text), cuts)).write.partitionBy("shard").parquet(path)
