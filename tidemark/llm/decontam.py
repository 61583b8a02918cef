"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `n` consecutive
words of an item; an item of fewer words, but not none, is one window. The windows' hashes are broadcast; every
window of every document is hashed with prefix sums over whole batches, looked up in a bit table and the sorted
hashes, and each hit is verified word by word. A word inside any occurrence of a window is hit.

The broadcast is bounded: items are dealt into blocks of at most `block_windows` windows (by a count taken first),
and one pass over the documents is made for each block, so a larger benchmark costs passes, not memory.

Defined results: null and word-free texts have no words and no hits; item ids are compared as strings; repeated
items count once; repeated rows give repeated results; an empty benchmark hits nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, portions, utf8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64; kept, so that each process computes them once."""
    if len(_known.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[:1] = 1
        _known[base] = np.cumprod(out, dtype=np.uint64)
    return _known[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Position-free polynomial hash of values[start:end], from prefix sums."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), n + 1)
    return _mix((total[end] - total[start]) * back[start])


class Words:
    """The words of many texts laid end to end: byte starts and ends, the text of each, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = _FOLD[data]
        inside = _IS_WORD[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(offsets) - 1)

    def hashes(self) -> np.ndarray:
        return _spans_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, _P)

    def join(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist()))


def _window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(len(words) - n + 1) if len(words) >= n else np.zeros(0, np.int64)
    return _spans_hash(words, at, at + n, _Q)


class Windows:
    """Windows of items: for each length, sorted hashes and a bit table of them; the items of each window's words."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        found: dict[int, dict[int, None]] = {}
        self.items: dict[bytes, list[str]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            words = Words(data, np.array([0, len(data)]))
            size = min(n, len(words.start))
            if not size:
                continue
            for i, h in enumerate(_window_hashes(words.hashes(), size).tolist()):
                found.setdefault(size, {})[h] = None
                own = self.items.setdefault(words.join(i, size), [])
                if item not in own:
                    own.append(item)
        self.by_length = []
        for size, hashes in sorted(found.items()):
            keys = np.array(sorted(hashes), np.uint64)
            bits = np.uint64(max(16, min(26, math.ceil(math.log2(64 * len(keys))))))
            seen = np.zeros(1 << int(bits), bool)
            seen[keys >> (np.uint64(64) - bits)] = True
            self.by_length.append((size, keys, bits, seen))

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every verified occurrence."""
        hashes = words.hashes() if self.by_length and len(words.start) else None
        for size, keys, bits, seen in self.by_length if hashes is not None else []:
            h = _window_hashes(hashes, size)
            at = np.flatnonzero(seen[h >> (np.uint64(64) - bits)])
            at = at[words.text[at] == words.text[at + size - 1]]
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            for i in at[keys[place] == h[at]].tolist():
                if items := self.items.get(words.join(i, size)):
                    yield i, size, items


def _hits(texts: pa.Array, windows: Windows) -> tuple[Words, list[list[dict]], list[set[str]]]:
    """The words of some texts; for each text its hit spans, merged, and the items that occur in it."""
    data, offsets = utf8(texts)
    words = Words(data, offsets)
    base = np.concatenate([[0], np.cumsum(words.count)])
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    step = np.zeros(len(words.start) + 1, np.int64)
    for i, size, own in windows.occurrences(words):
        step[i] += 1
        step[i + size] -= 1
        items[words.text[i]].update(own)
    hit = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
    edge = hit[1:] != hit[:-1]
    edge[base] = (hit[1:] | hit[:-1])[base]  # texts are apart
    for doc in np.unique(words.text[hit[1:-1]]).tolist():
        low, high = base[doc], base[doc + 1]
        marks = (np.flatnonzero(edge[low : high + 1]) + low).tolist()
        for a, b in zip(marks, marks[1:]):
            if hit[a + 1]:
                spans[doc].append({"first": a - low, "end": b - low, "from_byte": words.start[a] - offsets[doc], "to_byte": words.end[b - 1] - offsets[doc]})
    return words, spans, items


def scan(docs: DataFrame, windows: Windows, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: id, n_words, spans (hit word ranges [first, end), merged, as words and as bytes), items."""
    held = docs.sparkSession.sparkContext.broadcast(windows)
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, "text")):
            words, spans, items = _hits(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.count, pa.int64()), pa.array(spans, pa.list_(span)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["id", "n_words", "spans", "items"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, f"id {dict(ids.dtypes)['id']}, n_words bigint, spans array<struct<first: bigint, end: bigint, from_byte: bigint, to_byte: bigint>>, items array<string>").withColumnRenamed("id", id_col)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            if s["end"] > out[-1]["end"]:
                out[-1] = {**out[-1], "end": s["end"], "to_byte": s["to_byte"]}
        else:
            out.append(dict(s))
    return out


def _merge_blocks(parts: list[DataFrame], key: str) -> DataFrame:
    """The passes of several blocks as one row for each row of the documents; key is a row's own in each pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [_merged([s for part in row for s in part]) for row in b.column(2).to_pylist()]
            yield b.set_column(2, b.schema.field(2).name, pa.array(merged, b.schema.field(2).type.value_type))

    all_of = parts[0]
    for p in parts[1:]:
        all_of = all_of.unionByName(p)
    rows = all_of.groupBy(key).agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kinds = dict(parts[0].dtypes)
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, n_words bigint, spans {kinds['spans']}, items array<string>")


def _block_count(items: DataFrame, block_windows: int) -> int:
    # A text of b bytes has b / 2 + 1 words at most, and no more windows.
    most = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    return max(1, math.ceil(most / block_windows))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.where(F.col(item_text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))


def _windows(items: DataFrame, blocks: int, n: int) -> Iterator[Windows]:
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield Windows([tuple(r) for r in block.toLocalIterator()], n)


def window_blocks(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", item_text_col: str = "text", block_windows: int = 500_000) -> Iterator[Windows]:
    """The benchmark's windows in blocks of about block_windows at most; one block at least."""
    items = _items(benchmark, item_col, item_text_col)
    yield from _windows(items, _block_count(items, block_windows), n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = 500_000) -> DataFrame:
    """(id, n_words, spans, items) of each row of docs; ids may repeat or be null.

    A benchmark of up to block_windows windows is one pass. A larger one is several, over ids and texts written with
    a row number, by which their results meet.
    """
    items = _items(benchmark, item_col, item_text_col)
    count = _block_count(items, block_windows)
    blocks = _windows(items, count, n)
    if count == 1:
        return scan(docs, next(blocks), id_col, text_col)
    row = F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    rows = materialise(docs.select(row.alias("key"), F.col(text_col).cast("string").alias("text")), "rows")
    parts = [materialise(scan(rows, windows, "key", "text"), "contamination") for windows in blocks]
    return _merge_blocks(parts, "key").select(F.col("key.id").alias(id_col), "n_words", "spans", "items")


def n_hit(spans: str = "spans") -> Column:
    """Words inside the spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])


def _cut(texts: pa.Array, spans: list[list[dict]]) -> pa.Array:
    out = []
    for t, own in zip(texts.to_pylist(), spans):
        if t is not None and own:
            data, at, kept = t.encode(), 0, []
            for s in own:
                kept.append(data[at : s["from_byte"]])
                at = s["to_byte"]
            t = b"".join([*kept, data[at:]]).decode()
        out.append(t)
    return pa.array(out, texts.type)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "document", n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = 500_000) -> DataFrame:
    """docs without what the benchmark contaminates: whole documents, or (remove='span') the hit spans of their texts.

    Both work within the scan, without a shuffle; a benchmark of several blocks is as many scans, one after the
    other. All columns stay; null texts and null ids stay.
    """
    if remove not in ("document", "span"):
        raise ValueError(f"remove is 'document' or 'span', not {remove!r}")
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for windows in window_blocks(benchmark, n, item_col, item_text_col, block_windows):
        held = spark.sparkContext.broadcast(windows)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in portions(b, text_col)):
                _, spans, _ = _hits(batch.column(at), held.value)
                if remove == "document":
                    yield batch.filter(pa.array([not s for s in spans], pa.bool_()))
                else:
                    yield batch.set_column(at, batch.schema.field(at), _cut(batch.column(at), spans))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
