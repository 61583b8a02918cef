"""Runs of repeated words: stretches with a period, found from longest common extensions.

A portion of texts becomes one array of word numbers, a sentinel behind each text. Longest common extensions (LCE) come
from a difference cover: of the suffixes only those at positions whose remainder is in the cover are sorted, first by
their `v` words, then by doubling, which never leaves the sample. Neighbours' common lengths go into a sparse table for
range minima. For any two positions the cover names a distance below `v` after which both are sampled, so an LCE
compares that many words at most and then asks the table.

Runs are enumerated on harmonic grids: for each period p, every 2p-th position i is paired with i + p. A run of four
periods holds one of these at least p + 1 words before its end, so a pair whose extension is shorter goes at once; of
the others the start lies within 2p words before, found by halving over LCEs. Equal stretches keep their smallest period.

Defined results: null, empty and word-free texts have no runs and empty collapsed texts; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions, words_of

#: A perfect difference set: every distance below 31 is a difference of two of its remainders.
COVER, COVER_OF = (0, 1, 3, 8, 12, 18), 31


@dataclass(frozen=True)
class Rules:
    least_length: int = 6
    #: Four periods or more; the grid's spacing of two periods is sound from three on.
    least_periods: int = 4
    #: Pairs of a grid that are held at once.
    pairs: int = 1_000_000

    def __post_init__(self) -> None:
        if self.least_periods < 3:
            raise ValueError("runs of less than three periods escape the grid")


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of tuples, equal for equal ones."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Extensions:
    """Longest common extensions of positions of one array, up to `most` words."""

    def __init__(self, words: np.ndarray, most: int, cover: tuple[int, ...] = COVER, v: int = COVER_OF) -> None:
        n = len(words)
        self.v, self.n = v, n
        self.words = np.concatenate([words, np.arange(-1, -v - 1, -1)])  # nothing matches behind the end
        member = np.zeros(v, bool)
        member[list(cover)] = True
        # To positions of remainders a and b: how far until both are sampled.
        self.until = np.array([[next(d for d in range(v) if member[(a + d) % v] and member[(b + d) % v]) for b in range(v)] for a in range(v)], np.int64)
        sampled = np.flatnonzero(member[np.arange(n) % v])
        m = len(sampled)
        where = np.full(n + v, -1, np.int64)
        where[sampled] = np.arange(m)
        # The first v words, several in a key where their numbers are small.
        least, bits = int(self.words.min()), max(1, int(self.words.max() - self.words.min() + 1).bit_length())
        each = max(1, 62 // bits)
        keys = []
        for low in range(0, v, each):
            key = np.zeros(m, np.int64)
            for k in range(low, min(low + each, v)):
                key = (key << bits) | (self.words[sampled + k] - least)
            keys.append(key)
        ranks = [_dense(keys)] if m else [np.zeros(0, np.int64)]
        step = v
        while m and step < most and ranks[-1].max() < m - 1:
            to = sampled + step
            follow = np.where(to < n, where[np.minimum(to, n - 1)], -1)
            ranks.append(_dense([ranks[-1], np.where(follow >= 0, ranks[-1][follow], -1)]))
            step *= 2
        order = np.argsort(ranks[-1], kind="stable")
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        self.place = np.full(n + v, -1, np.int64)
        self.place[sampled] = place
        # Common lengths of neighbours, from the longest equal pieces down.
        a, b, common = sampled[order[:-1]].copy(), sampled[order[1:]].copy(), np.zeros(max(0, m - 1), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            size = v << level
            while True:
                at = np.flatnonzero((where[np.minimum(a, n)] >= 0) & (where[np.minimum(b, n)] >= 0) & (common < most))
                at = at[ranks[level][where[a[at]]] == ranks[level][where[b[at]]]]
                if not len(at):
                    break
                a[at] += size
                b[at] += size
                common[at] += size
                if level < len(ranks) - 1:
                    break
        at = np.flatnonzero((a < n) & (b < n) & (common < most))
        for _ in range(v):
            at = at[(a[at] < n) & (b[at] < n)]
            at = at[self.words[a[at]] == self.words[b[at]]]
            a[at] += 1
            b[at] += 1
            common[at] += 1
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i differs from j."""
        far = self.until[i % self.v, j % self.v]
        out = np.zeros(len(i), np.int64)
        at = np.arange(len(i))
        for d in range(int(far.max(initial=0))):
            at = at[(d < far[at]) & (i[at] + d < self.n) & (j[at] + d < self.n)]
            at = at[self.words[i[at] + d] == self.words[j[at] + d]]
            out[at] += 1
        at = np.flatnonzero((out == far) & (i + far < self.n) & (j + far < self.n))
        if not len(at):
            return out
        x, y = self.place[i[at] + far[at]], self.place[j[at] + far[at]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            t = self.table[k]
            out[at[own]] += np.minimum(t[low[own]], t[high[own] - (1 << k)])
        return out


def _grids(first: np.ndarray, size: np.ndarray, rules: Rules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p): for texts of `size` words from `first` on, the pairs (i, i + p) of the grid of each period, some at a time."""
    text, low = np.zeros(0, np.int64), 0
    periods = size // rules.least_periods
    total = int(periods.sum())
    ends = np.cumsum(periods)
    while low < total:
        # Texts and periods as one line, cut where the pairs of a part are enough.
        reach = min(total, low + rules.pairs)
        line = np.arange(low, reach)
        text = np.searchsorted(ends, line, side="right")
        p = line - (ends[text] - periods[text]) + 1
        count = (size[text] - p - 1) // (2 * p) + 1
        upto = max(1, int(np.searchsorted(np.cumsum(count), rules.pairs, side="right")))
        text, p, count = text[:upto], p[:upto], count[:upto]
        each = np.repeat(np.arange(upto), count)
        k = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        yield first[text][each] + 2 * p[each] * k, p[each]
        low += upto


def find_runs(words: np.ndarray, first: np.ndarray, size: np.ndarray, rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start and period, of texts of `size` words from `first` on; positions are those of the array.

    Texts must not touch: a number that no word has stands between them.
    """
    most = int(size.max(initial=0))
    found = []
    index = None
    for i, p in _grids(first, size, rules):
        # What an extension must reach for the run to be long enough, its start being less than 2p before.
        need = np.maximum(rules.least_length, rules.least_periods * p) - 3 * p + 1
        for d in (0, 1):
            ok = (words[i + d] == words[np.minimum(i + d + p, len(words) - 1)]) | (need <= d)
            i, p, need = i[ok], p[ok], need[ok]
        if not len(i):
            continue
        index = index or Extensions(words, most)
        forward = index.lce(i, i + p)
        ok = forward >= need
        i, p, forward = i[ok], p[ok], forward[ok]
        # The smallest start from which the words agree up to i; one 2p before i belongs to an earlier pair of the grid.
        begin = first[np.searchsorted(first, i, side="right") - 1]
        low, high = np.maximum(i - 2 * p, begin), i.copy()
        while len(at := np.flatnonzero(low < high)):
            middle = (low[at] + high[at]) // 2
            good = index.lce(middle, middle + p[at]) >= i[at] - middle
            high[at] = np.where(good, middle, high[at])
            low[at] = np.where(good, low[at], middle + 1)
        length = i + forward + p - low
        own = (low > i - 2 * p) & (length >= np.maximum(rules.least_length, rules.least_periods * p))
        found.append(np.stack([low[own], length[own], p[own]], axis=1))
    got = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    got = got[new]
    got = got[np.lexsort((got[:, 2], got[:, 0]))]
    return got[:, 0], got[:, 1], got[:, 2]


def repeat_from(n: int, id_text: str) -> np.ndarray:
    """Which of n words stands at each place once a tail is overwritten with its own beginning, again and again, as a hash of the id decides."""
    own = np.arange(n)
    h = zlib.crc32(id_text.encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own[a:] = a + (own[a:] - a) % p
    return own


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked words as bytes, each with a space behind it, and where each begins (one more than words)."""
    size = end[picked] - start[picked] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(start[picked] - at[:-1], size) + np.arange(at[-1])
    source[at[1:] - 1] = 0
    out = data[source] if len(data) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 0x20
    return out, at


NAMES = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"]
KINDS = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, runs_sha256 string, collapsed_sha256 string"


def _measured(ids: list, texts: pa.Array, repeat_tails: bool, collapsed: bool, rules: Rules) -> list[list]:
    data, start, end, number, edges = words_of(texts)
    n = len(edges) - 1
    size = np.diff(edges)
    order = np.arange(len(number))
    if repeat_tails:
        for k, i in enumerate(ids):
            if i is not None and size[k]:
                order[edges[k] : edges[k + 1]] = edges[k] + repeat_from(int(size[k]), str(i))
    # Each text with a sentinel behind it.
    first = edges[:-1] + np.arange(n)
    words = np.full(len(number) + n, -1, np.int64)
    words[np.repeat(first - edges[:-1], size) + np.arange(len(number))] = number[order]
    s, length, p = find_runs(words, first, size, rules)
    owner = np.searchsorted(first, s, side="right") - 1
    # Words that a run holds behind its first period go.
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, s + p, 1)
    np.add.at(step, s + length, -1)
    dropped = np.cumsum(step)[:-1] > 0
    keep = ~dropped[np.repeat(first - edges[:-1], size) + np.arange(len(number))]
    whose = np.repeat(np.arange(n), size)[keep]
    line, at = _joined(data, start, end, order[keep])
    line = line.tobytes()
    kept = np.searchsorted(whose, np.arange(n + 1))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    s = s - first[owner]
    out: list[list] = [[] for _ in range(len(NAMES) + collapsed)]
    for k in range(n):
        own = list(zip(*(x[bounds[k] : bounds[k + 1]].tolist() for x in (s, length, p))))
        # Greatest exact length / period; the first of equal ones, which come by start and period.
        best = None
        for r in own:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        text = line[at[kept[k]] : max(at[kept[k]], at[kept[k + 1]] - 1)]
        runs_text = "".join("%d,%d,%d\n" % r for r in own)
        row = [int(size[k]), len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, [dict(zip(("start", "length", "period"), r)) for r in own]]
        row += [hashlib.sha256(runs_text.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), *[text.decode()] * collapsed]
        for column, value in zip(out, row):
            column.append(value)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_tails: bool = False, collapsed: bool = False, rules: Rules = Rules()) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed_sha256), and the collapsed text if asked for.

    start, length and period are those of the run with the greatest exponent; collapsed: the text without what runs
    repeat, words joined by one space. repeat_tails first overwrites the tails of a tenth of the texts periodically, by
    their ids (a null id's text stays).
    """
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 6 + [pa.list_(struct), pa.string(), pa.string()] + [pa.string()] * collapsed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, "text", 1_000_000)):
            columns = _measured(batch.column(0).to_pylist(), batch.column(1), repeat_tails, collapsed, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *NAMES, *["collapsed"] * collapsed])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, f"id {dict(ids.dtypes)['id']}, {KINDS}" + ", collapsed string" * collapsed).withColumnRenamed("id", id_col)
