"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import runs
from tidemark.llm.common import words_of

LONG = "lorem ipsum dolor " * 20_000


def brute_runs(w):
    """(start, length, period): for each period the maximal stretches that keep it, the smallest period of equal ones."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                found.setdefault((i, length), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def brute_row(i, text, repeat_tails):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if repeat_tails and i is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    dropped = {k for s, length, p in found for k in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (n, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def _texts(rng, n):
    for _ in range(n):
        kind, alphabet = rng.random(), ["a", "b", "ç", "漢", "dd"][: rng.randint(1, 5)]
        if kind < 0.5:
            yield " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
        else:
            parts = []
            for _ in range(rng.randint(1, 5)):
                base = [rng.choice(["a", "b", "c", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(1, 12))]
                parts += (base * 9)[: rng.randint(1, 9 * len(base))]
            yield rng.choice([" ", "\n", " \t"]).join(parts)


def test_extensions_equal_direct_comparison():
    rng = np.random.default_rng(5)
    for letters, n in ((1, 200), (2, 700), (3, 64), (50, 400), (2, 31), (2, 5)):
        w = np.concatenate([np.tile(rng.integers(0, letters, max(1, n // 3)), 3), [-1]])
        index = runs.Extensions(w, len(w))
        i, j = rng.integers(0, len(w), 400), rng.integers(0, len(w), 400)
        i, j = i[i != j], j[i != j]
        for x, y, got in zip(i, j, index.lce(i, j)):
            k = 0
            while max(x, y) + k < len(w) and w[x + k] == w[y + k]:
                k += 1
            assert got == k, (letters, n, x, y)


def test_runs_equal_brute_force_on_words():
    rng = random.Random(3)
    for _ in range(40):
        texts = list(_texts(rng, 25))
        data, start, end, number, edges = words_of(pa.array(texts))
        assert [data[a:b].tobytes().decode() for a, b in zip(start, end)] == [x for t in texts for x in t.split()]
        size = np.diff(edges)
        first = edges[:-1] + np.arange(len(size))
        words = np.full(len(number) + len(size), -1, np.int64)
        for k in range(len(size)):
            words[first[k] : first[k] + size[k]] = number[edges[k] : edges[k + 1]]
        for rules in (runs.Rules(), runs.Rules(pairs=50)):
            got = list(zip(*(x.tolist() for x in runs.find_runs(words, first, size, rules))))
            want = [(s + f, length, p) for f, t in zip(first.tolist(), texts) for s, length, p in brute_runs(t.split())]
            assert got == want


def test_known_runs():
    fib = "a", "ab"
    while len(fib[1]) < 2_000:
        fib = fib[1], fib[1] + fib[0]
    assert runs.find_runs(np.array([ord(c) for c in fib[1]] + [-1]), np.array([0]), np.array([len(fib[1])]))[0].size == len(brute_runs(fib[1])) == 0
    w = np.array([1, 2, 3] * 5 + [7] * 6 + [8, 9] * 3 + [-1])
    assert list(zip(*(x.tolist() for x in runs.find_runs(w, np.array([0]), np.array([27]))))) == [(0, 15, 3), (15, 6, 1)]
    with pytest.raises(ValueError):
        runs.Rules(least_periods=2)


def test_periodic_runs(spark):
    rng = random.Random(4)
    texts = [*_texts(rng, 300), None, "", " \n\t", "a", LONG, "ab\n" * 4_000 + "c " * 9_000, "x\x00y " * 8, "a\x0bb\x0cc " * 7, "a b " * 9]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "z z z z z z z")], "doc_id long, text string").repartition(3).select("*", *[F.lit("clash").alias(c) for c in ("id", "start", "runs", "n_runs", "collapsed")])
    for tails in (True, False):
        found = runs.periodic_runs(df, repeat_tails=tails, collapsed=True).collect()
        assert len(found) == len(texts) + 2
        for r in found:
            text = "z z z z z z z" if r.doc_id is None else texts[r.doc_id]
            if text is not LONG:
                assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == brute_row(r.doc_id, text, tails), (r.doc_id, tails)
            assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    plain = {r.doc_id: r for r in found}
    assert (plain[304].n_runs, plain[304].length, plain[304].period, plain[304].collapsed) == (1, 60_000, 3, "lorem ipsum dolor")
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_op11_equals_brute_force_on_documents(spark):
    from tidemark.llm import registry

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = registry.QUERIES["op11_runs"](spark, sf).collect()
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found) > 10
    for r in found:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == brute_row(r.doc_id, texts[r.doc_id], True)[1:]
