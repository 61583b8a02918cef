"""Byte-level BPE by vectorised pre-tokenisation and cached pair merging.

Texts of a batch are laid end to end as code points. A table maps code points to classes (letter, number, 0x20,
other white space, other), lookups of the neighbours refine them into the symbols of a small automaton, and each
symbol is a transition function on its states. The functions compose associatively, and any few of them in a row
are constant, so a doubling scan over the function numbers ends after a few passes with the state after every
code point. State and symbol say where a piece begins; no regular expression is run.

Pieces are looked up in a cache of their ids; a piece not yet seen is merged by rank, lowest first, leftmost on
ties. Ids, byte offsets of the tokens and the decoded bytes are the outputs.

Defined results: null is the empty text, which has no ids; repeated rows give repeated results; no special
tokens: their strings are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces kept by the cache of one process at most; when it is full, it begins anew.
CACHE_PIECES = 200_000

#: The code points of \s in the pre-tokenisation pattern.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _BLANK, _WHITE = range(5)
# Symbols: the five classes, white space that is the last of a run before other text, apostrophes that begin a
# contraction of one or two letters if a piece begins there, and the begin of a text.
_LAST_BLANK, _LAST_WHITE, _SHORT, _LONG, _BEGIN = range(5, 10)
# States: what the piece that holds the code point may take next.
_S_FREE, _S_LETTERS, _S_NUMBERS, _S_OTHERS, _S_WHITE, _S_JOIN, _S_ONE, _S_TWO = range(8)


def _next(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins with it."""
    if symbol == _BEGIN:
        return _S_FREE, True
    if state == _S_TWO:
        return _S_ONE, False
    if state == _S_ONE:
        return _S_FREE, False
    kind = _OTHER if symbol in (_SHORT, _LONG) else symbol
    goes_on = {_LETTER: _S_LETTERS, _NUMBER: _S_NUMBERS, _OTHER: _S_OTHERS}.get(kind)
    if goes_on is not None:
        if state in (goes_on, _S_JOIN):
            return goes_on, False
        if symbol == _SHORT:
            return _S_ONE, True
        return (_S_TWO if symbol == _LONG else goes_on), True
    if symbol == _LAST_BLANK:
        return _S_JOIN, True
    if symbol == _LAST_WHITE:
        return _S_FREE, True
    return _S_WHITE, state != _S_WHITE


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All products of the symbols' transition functions: their images, the product table, and which are constant."""
    basic = [tuple(_next(s, x)[0] for s in range(8)) for x in range(10)]
    known = {f: i for i, f in enumerate(dict.fromkeys(basic))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[f[s]] for s in range(8)), tuple(f[g[s]] for s in range(8))):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    all_of = list(known)
    product = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in all_of] for f in all_of], np.uint16)
    return np.array(all_of, np.uint8), product, np.array([len(set(f)) == 1 for f in all_of]), np.array([known[f] for f in basic], np.uint16)


_IMAGES, _PRODUCT, _CONSTANT, _OF_SYMBOL = _functions()
_BEGINS = np.array([[_next(s, x)[1] for x in range(10)] for s in range(8)])


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    first = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_SPACES] = _WHITE
    out[0x20] = _BLANK
    return out


def piece_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points laid end to end; texts holds each non-empty text's first position."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    ends = np.append(texts[1:], n) - 1  # each text's last position
    after = np.append(points[1:], 0)
    after[ends] = 0
    then = np.append(after[1:], 0)
    then[ends] = 0
    white = kind >= _BLANK
    last = white & ~np.append(white[1:], True)
    last[ends] = False
    symbol = kind + 2 * last * (kind == _BLANK) + 2 * last * (kind == _WHITE)
    quote = np.flatnonzero(points == 0x27)
    a, b = after[quote], then[quote]
    short = np.isin(a, [ord(c) for c in "stmd"])
    long = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    symbol[quote[short]] = _SHORT
    symbol[quote[long]] = _LONG
    # The begin of a text is a symbol of its own before the text's first.
    f = _OF_SYMBOL[symbol]
    f[texts] = _PRODUCT[_OF_SYMBOL[_BEGIN], f[texts]]
    step = 1
    while step < n and not _CONSTANT[f].all():
        f = np.concatenate([f[:step], _PRODUCT[f[:-step], f[step:]]])
        step *= 2
    before = np.concatenate([[_S_FREE], _IMAGES[f[:-1], 0]])
    begins = _BEGINS[before, symbol]
    begins[texts] = True
    return np.flatnonzero(begins)


class Vocabulary:
    """Ranks of byte strings, and the merging of pieces."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the adjacent pair of lowest rank is merged, leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two was merged meanwhile
            alive[j] = False
            end[i], nxt[i] = stop, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and n + 1 offsets into them."""
        sizes = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, firsts[sizes > 0])
        at = starts.tolist()
        cache, ids = self.cache, []
        if len(cache) > CACHE_PIECES:
            cache.clear()
        for a, b in zip(at, [*at[1:], len(joined)]):
            piece = joined[a:b]
            if (own := cache.get(piece)) is None:
                own = cache[piece] = tuple(self.merge(piece.encode()))
            ids.append(own)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum()))
        before = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.append(before[np.searchsorted(starts, firsts)], before[-1])

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(self.tokens) + 1
        lengths = np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            lengths[i] = len(t)
        return np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8), np.cumsum(lengths) - lengths, lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, where each text's begin (n + 1), and where each id's begin."""
        data, first, lengths = self._table
        own = lengths[ids]
        ends = np.cumsum(own)
        begin = ends - own
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(first[ids] - begin, own)
        return data[gather], np.append(begin, total)[offsets], begin


_held: dict[str, Vocabulary] = {}


def _vocabulary(key: str, lines: bytes) -> Vocabulary:
    """One vocabulary, and so one cache, for each process."""
    if key not in _held:
        _held[key] = Vocabulary(lines)
    return _held[key]


def _read(path: str | None) -> tuple[str, bytes]:
    path = path or public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        return path, f.read()


#: Output columns by name: their types in Spark.
OUTPUTS = {"token_ids": "array<int>", "token_starts": "array<int>", "decoded": "binary"}


def encode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, outputs: tuple[str, ...] = ("token_ids", "token_starts")) -> DataFrame:
    """docs with token_ids, token_starts (first byte of each token in the UTF-8 text) and/or decoded (bytes of the ids).

    The driver reads the rank file (under 1 MB) and broadcasts it. Columns of docs with those names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    base = docs.drop(*outputs)
    at = base.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(*held.value)
        for batch in (p for b in batches for p in portions(b, text_col, 1_000_000)):
            ids, offsets = vocabulary.encode([t or "" for t in batch.column(at).to_pylist()])
            made = {"token_ids": lambda: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
            if {"token_starts", "decoded"} & set(outputs):
                data, firsts, begin = vocabulary.decode(ids, offsets)
                starts = begin - np.repeat(firsts[:-1], np.diff(offsets))
                made["token_starts"] = lambda: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(starts, pa.int32()))
                made["decoded"] = lambda: pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(firsts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[made[o]() for o in outputs]], names=[*batch.schema.names, *outputs])

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(run, schema + "".join(f", {o} {OUTPUTS[o]}" for o in outputs))


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """encoded with out_col: the bytes of the ids. Null ids give null; an id outside the vocabulary fails."""
    held = encoded.sparkSession.sparkContext.broadcast(_read(ranks_path))
    base = encoded.drop(out_col)
    at = base.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _vocabulary(*held.value).tokens
        for b in batches:
            out = [None if own is None else b"".join([tokens[i] for i in own]) for own in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, out_col])

    return base.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in base.dtypes) + f", `{out_col}` binary")


def ids_sha256(ids: str = "token_ids") -> Column:
    """Lowercase hex of the SHA-256 of the decimal ids, joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256)
