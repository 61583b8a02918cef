"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

Texts of a batch are laid end to end as bytes and cut into words `[^\\x20\\x09-\\x0D]+`, which are numbered by their bytes.
Prefix sums give every n-word window and every line a 64-bit hash; what has the hash of an earlier one of its text is
compared with that one, word by word or byte by byte. Windows that occur twice within a text are repeated, and the code
points of the words that they cover, over those of all words, are that length's coverage. The same holds for the
characters in lines that equal an earlier line.

Defined results: null and word-free texts have zeros, fail the base rule and have coverage 0; repeated rows give
repeated results; an empty table gives no rows. Hashes decide what is compared, never what is equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions, utf8, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_P, _Q = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict: the base rule's, then the largest shares of characters in repeated windows and lines.

    Fixed values: the shares are those of Rae et al. 2021, falling with the window's length, so that a document within the
    base rule is rejected for longer repeated passages.
    """

    least_words: int = 50
    repeat_window: int = 3
    most_repeat_percent: int = 50
    windows: tuple[tuple[int, float], ...] = ((5, 0.15), (7, 0.13), (10, 0.10))
    most_line_share: float = 0.2


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_known.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[:1] = 1
        _known[base] = np.cumprod(out, dtype=np.uint64)
    return _known[base][:n]


def _hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on its place."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    x = (total[end] - total[start]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[start]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(28))


def _with_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """h, made different for each text."""
    return h ^ ((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """Whether the pieces a and b of data[start:end] have the same bytes, some millions of bytes at a time."""
    size = end[a] - start[a]
    same = size == end[b] - start[b]
    at = np.flatnonzero(same & (size > 0))
    cuts = np.concatenate([[0], np.cumsum(size[at])])
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + most, side="right")) - 1)
        own = at[low:high]
        if len(own) == 1:
            same[own[0]] = np.array_equal(data[start[a[own[0]]] : end[a[own[0]]]], data[start[b[own[0]]] : end[b[own[0]]]])
        else:
            k = np.arange(cuts[high] - cuts[low])
            step = np.repeat(cuts[low:high] - cuts[low], size[own])
            equal = data[k + np.repeat(start[a[own]], size[own]) - step] == data[k + np.repeat(start[b[own]], size[own]) - step]
            same[own] = np.logical_and.reduceat(equal, cuts[low:high] - cuts[low])
        low = high
    return same


def earlier(h: np.ndarray, same, content) -> np.ndarray:
    """For each of some pieces, the first one equal to it; h: their hashes, same(a, b): whether pieces are equal, content(a): what tells them apart.

    Pieces are compared with the first of their hash. Where one differs from it, its hash's pieces are told apart by content.
    """
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    first = np.empty(len(h), np.int64)
    first[order] = order[begin][np.cumsum(new) - 1]
    asked = np.flatnonzero(first != np.arange(len(h)))
    differ = asked[~same(asked, first[asked])]
    for group in np.unique(first[differ]).tolist():
        known: dict = {}
        for k in np.flatnonzero(first == group).tolist():
            first[k] = known.setdefault(content(k), k)
    return first


def _twice(first: np.ndarray) -> np.ndarray:
    """Whether each piece has an equal one, from the first of each."""
    found = first != np.arange(len(first))
    found[first[found]] = True
    return found


def _sums(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights, minlength=n).astype(np.int64)


class Measures:
    """Counts and coverages of many texts."""

    def __init__(self, column: pa.Array, rules: Rules) -> None:
        data, start, end, words, edges = words_of(column)
        _, offsets = utf8(column)
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        text = np.repeat(np.arange(n), np.diff(edges))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = points[end] - points[start]
        self.n_words, self.word_chars = _sums(text, n), _sums(text, n, chars)
        self.n_symbols = _sums(owner[_SYMBOL[data]], n)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(_P)
        mixed ^= mixed >> np.uint64(32)
        self.covered = {}
        for k in sorted({rules.repeat_window, *(k for k, _ in rules.windows)}):
            at = np.arange(max(0, len(words) - k + 1))
            at = at[text[at] == text[at + k - 1]]
            same = lambda a, b: np.logical_and.reduce([words[at[a] + j] == words[at[b] + j] for j in range(k)])  # noqa: B023, E731
            first = earlier(_with_text(_hash(mixed, at, at + k, _Q), text[at]), lambda a, b: same(a, b) & (text[at[a]] == text[at[b]]), lambda a: (text[at[a]], *words[at[a] : at[a] + k].tolist()))  # noqa: B023
            again = at[_twice(first)]
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, again, 1)
            np.add.at(step, again + k, -1)
            hit = np.cumsum(step)[:-1] > 0
            self.covered[k] = _sums(text[hit], n), _sums(text[hit], n, chars[hit])
        self._lines(data, offsets, owner, start, end, chars)

    def _lines(self, data, offsets, owner, start, end, chars) -> None:
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        begin = np.concatenate([offsets[:-1], breaks + 1])
        stop = np.concatenate([offsets[1:], breaks])
        whose = np.concatenate([np.arange(n), owner[breaks]])
        order = np.lexsort((begin, whose))
        begin, whose = begin[order], whose[order]
        stop = np.concatenate([stop[n:], stop[:n]])
        stop = stop[np.lexsort((stop, np.concatenate([owner[breaks], np.arange(n)])))]
        low, high = np.searchsorted(start, begin), np.searchsorted(start, stop)
        worded = high > low
        begin, stop, whose, low, high = (x[worded] for x in (begin, stop, whose, low, high))
        total = np.concatenate([[0], np.cumsum(chars)])
        h = _with_text(_hash(data.astype(np.uint64) + np.uint64(1), begin, stop, _P), whose)
        equal = lambda a, b: _same_bytes(data, begin, stop, a, b) & (whose[a] == whose[b])
        first = earlier(h, equal, lambda a: (whose[a], data[begin[a] : stop[a]].tobytes()))
        later = first != np.arange(len(h))
        self.n_dup_lines = _sums(whose[later], n)
        self.dup_line_chars = _sums(whose[later], n, (total[high] - total[low])[later])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, share_<length>…, line_share).

    share_<length>: coverage by repeated windows of that many words. Other columns of docs are ignored.
    """
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"share_{k}" for k, _ in rules.windows), "line_share"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, "text", 2_000_000)):
            m = Measures(batch.column(1), rules)
            repeat = m.covered[rules.repeat_window][0]
            failed = (m.n_words < rules.least_words) | (100 * repeat > rules.most_repeat_percent * m.n_words)
            shares = [_share(m.covered[k][1], m.word_chars) for k, _ in rules.windows]
            line = _share(m.dup_line_chars, m.word_chars)
            kept = ~failed & (line <= rules.most_line_share)
            for share, (_, most) in zip(shares, rules.windows):
                kept &= share <= most
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, repeat, failed, kept, *shares, line))], names=names)

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"] * (len(rules.windows) + 1)
    schema = f"id {dict(ids.dtypes)['id']}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds))
    return ids.mapInArrow(run, schema).withColumnRenamed("id", id_col)
