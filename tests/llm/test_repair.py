"""Conversation repair against a search of all edit sequences by increasing cost."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import registry, repair


def brute_edits(rows):
    """(cost, audit, left over) of rows (role, text, fault): whole sequences in the order of cost, then of their initials."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        # Roles matter by their last one and whether there are any; the first to come is the cheapest and least.
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))

        def push(more, edit, j, role=None, row=None):
            new = roles + role[0] if role else roles
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + edit, j, new, (*out, row) if row else out))

        for role in ("user", "assistant"):
            push(2, "I", i, role, (role, ""))
        if i < len(rows):
            role, text, fault = rows[i]
            push(3, "D", i + 1)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    push(extra, "K", i + 1, role, (role, text))
                for r in ("user", "assistant"):
                    if r[0] != role[:1]:
                        push(2 + extra, "R", i + 1, r, (r, text))
    raise AssertionError


def brute_row(rows):
    """Of a conversation's rows (turn, role, text) in order."""
    seen, faulted = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
        seen.add((role, text))
        faulted.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, left = brute_edits(faulted)
    kinds = [f for *_, f in faulted]
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def brute(table, damage):
    """By conversation, of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in table:
        own = out.setdefault(conv, [])
        named = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20 if damage else 19
        role, text = named(role), named(text)
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        own += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: brute_row(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))) for c, r in out.items()}


def test_search_equals_all_sequences():
    rng = random.Random(8)
    kinds = {None: repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool"] if rng.random() < 0.5 else ["user", "assistant"]), "t", rng.choice([None, None, None, *kinds])) for _ in range(rng.randint(0, 9))]
        found = repair.search([(r[:1], kinds[f]) for r, _, f in rows])
        cost, audit, _ = brute_edits(rows)
        assert (found.cost + repair.END[found.end], found.audit + "I" * repair.MISSING[found.end]) == (cost, audit)
    assert repair.search([("u", 0)], repair.AFTER_U, (0.0, *[repair.NEVER] * 3)) is None


def _compare(of, table, damage):
    want = brute(table, damage)
    got = {r.conv_id: tuple(r)[1:] for r in repair.summary(of).collect()}
    assert got == want


@pytest.fixture(scope="module")
def table():
    rng = random.Random(9)
    texts = ["Hi.", "no end", " \n\t", "", "What?", "x!", "é.", None, "Long. " * 50]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 3, 8, 30])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"turn {turn} of {conv}."
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]) if rng.random() < 0.97 else None, role if rng.random() < 0.97 else rng.choice([None, "tool", ""]), text))
    rows += [(100, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"hot {t}" + "." * (t % 5 > 0)) for t in range(700)]
    rows += [(101, None, "user", "same."), (101, None, "user", "same."), (102, 3, "user", "b."), (102, 3, "user", "a.")]
    return rows


@pytest.mark.parametrize("tile_rows", [2, 64])
def test_repair(spark, table, tile_rows):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("at", "low", "fault", "rows", "tile")])
    _compare(repair.repair(df, tile_rows), table, damage=False)
    if tile_rows == 64:
        of = repair.repair(repair.damaged(df), tile_rows)
        _compare(of, table, damage=True)
        turns = of.turns().where("conv_id = 100").orderBy("low", "k").collect()
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns))
        assert repair.summary(repair.repair(df.limit(0))).count() == 0


def test_dropped_conversations_stay(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert repair.summary(repair.repair(repair.damaged(df))).collect() == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_op13_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows, True)
    assert {r.conv_id: tuple(r)[1:] for r in registry.QUERIES["op13_conversations"](spark, sf).collect()} == want
