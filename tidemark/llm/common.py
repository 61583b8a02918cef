"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written here and not yet dropped.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a temporary one only for a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes folders written here (all by default), once nothing reads them any more."""
    for path in list(_written) if paths is None else paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without a copy, and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None and len(at) else np.zeros(0, np.uint8)
    return data, at - at[0]


def portions(batch: pa.RecordBatch, text: str, most: int = 1_000_000):
    """Slices of a batch of about `most` bytes of text each (one row at least), so that work arrays stay small."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text array: the bytes, each word's start and end in them, its number (equal for equal words), and each text's first word (n + 1)."""
    data, offsets = utf8(column)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)])
    joined = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    number = joined.dictionary_encode().indices.to_numpy().astype(np.int64)
    return data, start, end, number, np.searchsorted(start, offsets)
