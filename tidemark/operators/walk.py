"""Greedy walks along pointers: which nodes a walk visits, without holding a chain in one task.

Many greedy rules are walks: from a node taken the next one taken is known, whatever was taken before. Nodes
(tape_id, i, nx) point forward, nx > i or null at an end; a tape's walk begins at its smallest i. A chain is cut into
blocks of `block` numbers. Within a block pointers are doubled until each leads out of it. The few nodes at which blocks
are entered make a smaller chain, whose visited ones are marked by doubling over written tables: after k rounds the
first 2^k. Each block that is entered is then walked from its entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written

BLOCK = 4096
#: What stands for no pointer.
_END = np.int64(2**62)


def _by_block(df: DataFrame, columns: list[str], schema: str, make: Callable[..., list[np.ndarray]]) -> DataFrame:
    """make(i, nx, …) over the nodes of each (tape_id, b), sorted by i; its arrays and the tape make rows."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None

        def found() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.concat_tables(held)
                out = make(*[t.column(c).to_numpy() for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out[0]), pa.string()), *map(pa.array, out)], names=["tape_id", *names])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = list(zip(t.column("tape_id").to_pylist(), t.column("b").to_pylist()))
            low = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[low]:
                    if keys[low] != key:
                        yield from found()
                        held, key = [], keys[low]
                    held.append(t.slice(low, k - low))
                    low = k
        yield from found()

    rows = df.select("tape_id", "b", *columns).repartition("tape_id", "b").sortWithinPartitions("tape_id", "b", "i")
    return rows.mapInArrow(run, f"tape_id string, {schema}")


def _exits(i: np.ndarray, nx: np.ndarray) -> list[np.ndarray]:
    """Where each node's walk leaves the block."""
    while True:
        inside = nx <= i[-1]
        if not inside.any():
            return [i, nx]
        nx = np.where(inside, nx[np.searchsorted(i, np.where(inside, nx, i[0]))], nx)


def _visited(i: np.ndarray, nx: np.ndarray, entry: np.ndarray) -> list[np.ndarray]:
    """The nodes that a walk from the block's entry visits."""
    out, k = [], int(entry[0])
    while k <= i[-1]:
        out.append(k)
        k = int(nx[np.searchsorted(i, k)])
    return [np.array(out, np.int64)]


def walked(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tape_id, i): the nodes (tape_id, i, nx) that each tape's walk visits; pointers are nodes of the tape or null."""
    own = nodes.select("tape_id", F.col("i").cast("bigint").alias("i"), F.coalesce(F.col("nx").cast("bigint"), F.lit(int(_END))).alias("nx"))
    own = written(own.withColumn("b", F.floor(F.col("i") / block)), "nodes")
    exits = written(_by_block(own, ["i", "nx"], "i bigint, nx bigint", _exits), "exits")
    visited = written(own.groupBy("tape_id").agg(F.min("i").alias("i")), "visited")
    points = exits.where(F.col("nx") < int(_END))
    entries = points.select("tape_id", F.col("nx").alias("i")).distinct()
    # Pointers between entries only.
    jump = written(points.join(entries.unionByName(visited).distinct(), ["tape_id", "i"], "left_semi"), "jumps")
    n = visited.count()
    while not jump.isEmpty():
        visited = written(visited.unionByName(visited.join(jump, ["tape_id", "i"]).select("tape_id", F.col("nx").alias("i"))).distinct(), "visited")
        last, n = n, visited.count()
        if n == last:
            break
        jump = written(jump.join(jump.select("tape_id", F.col("i").alias("nx"), F.col("nx").alias("__far")), ["tape_id", "nx"]).select("tape_id", "i", F.col("__far").alias("nx")), "jumps")
    at = visited.select("tape_id", F.floor(F.col("i") / block).alias("b"), F.col("i").alias("entry"))
    return _by_block(own.join(at, ["tape_id", "b"]), ["i", "nx", "entry"], "i bigint", _visited)
