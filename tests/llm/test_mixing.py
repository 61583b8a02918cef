"""The mix against a plain simulation of its rules, its SQL, and the sequence's promises."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, registry


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets of (name, size), null last: the excess is shared again, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and most * sizes[s] * free < w[s] * left}
        if not above:
            return {s: (most * sizes[s], most * sizes[s]) if s in capped else (w[s] * left / free, w[s] * left // free) for s in order}
        capped |= above


def brute_taken(rows, words):
    """Words taken of each row index, reading each source's stream word by word."""
    taken = [0] * len(rows)
    for source, most in words.items():
        own = sorted((k for k in range(len(rows)) if rows[k][1] == source), key=lambda k: (hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest(), rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
        left = most
        while left > 0:
            for k in own:
                n = min(left, rows[k][2])
                taken[k] += n
                left -= n
    return taken


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    names = ["s1", "s10", "s2", "ä", "Z", None, "empty", "tiny"]
    texts = []
    for i in range(400):
        source = "s1" if rng.random() < 0.4 else rng.choice(names[:6])
        texts.append((i, " ".join(["wörd"] * rng.choice([0, 1, 2, 30, 200])), source))
    texts += [(400, "", "empty"), (401, None, "empty"), (402, "a\x0bb \t c", "tiny"), (403, "w " * 9_000, "s2"), (7, "again w", "s1"), (7, "again w", "s1"), (None, "no id", "s1"), (None, "no", "tiny")]
    return texts


def test_mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).select("*", *[F.lit("clash").alias(c) for c in ("row", "size", "no", "target", "taken", "h", "part")])
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    goal = brute_targets(sizes)
    assert sum(t for t, _ in goal.values()) == pytest.approx(sum(sizes.values())) and any(t == 3 * sizes[s] for s, (t, _) in goal.items())
    want = sorted(((i, n, sizes[s], goal[s][0], t) for (i, s, n), t in zip(sized, brute_taken(sized, {s: w for s, (_, w) in goal.items()}))), key=repr)
    for config in (mixing.Config(), mixing.Config(block_words=7, part_rows=3), mixing.Config(block_words=64, part_rows=50)):
        got = sorted((tuple(r) for r in mixing.mix(df, config=config).collect()), key=repr)
        assert got == want
    assert all(t <= 3 * n for _, n, _, _, t in want)
    assert mixing.mix(df.limit(0)).count() == 0
    none = mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("size"), F.sum("target"), F.sum("taken")).first()
    assert tuple(none) == (0, 0.0, 0)


def test_pieces_follow_the_schedule(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    config = mixing.Config(block_words=7, part_rows=3)
    m = mixing.mixture(df, config=config)
    by_slot = {}
    for r in m.pieces.collect():
        by_slot.setdefault(r.slot, []).append(r)
    assert len({(p[0].source, p[0].block) for p in by_slot.values()}) == len(by_slot)
    blocks = {}
    for slot in sorted(by_slot):
        p = by_slot[slot]
        n = sum(r.high - r.low for r in p)
        assert len({(r.source, r.block) for r in p}) == 1 and n <= 7
        blocks.setdefault(p[0].source, []).append((p[0].block, n))
    # A source's slots take its blocks in order, full but for the last.
    for found in blocks.values():
        assert [b for b, _ in found] == list(range(len(found))) and all(n == 7 for _, n in found[:-1])
    # Low discrepancy: in every beginning of the mix each source is near its share.
    order = [by_slot[s][0].source for s in sorted(by_slot)]
    total = {s: order.count(s) / len(order) for s in set(order)}
    seen = dict.fromkeys(total, 0)
    for k, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - k * total[x]) < 2 + len(order).bit_length() / 2 for x in total)


def test_schedule_ranks_equal_a_window(spark):
    of = spark.createDataFrame([(0, 7), (1, 0), (2, 100), (3, 1), (4, 5000), (5, 63)], "no long, words long")
    for block, chunk in ((1, 5), (3, 4096)):
        got = mixing.schedule(of, mixing.Config(block_words=block), chunk=chunk).collect()
        assert len({r.slot for r in got}) == len(got) == sum(-(-n // block) for n in (7, 0, 100, 1, 5000, 63))
        seen = {}
        for r in sorted(got, key=lambda r: r.slot):
            assert r.block == seen.get(r.no, 0)
            seen[r.no] = r.block + 1
    assert mixing.schedule(of.limit(1), mixing.Config(block_words=9)).collect() == [(0, 0, 0)]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(registry.SQL["op12_mixing"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["op12_mixing"](spark, sf).collect()) == want
