"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

Edits of a row: Keep (0), Rerole to user or assistant (2), Delete (3; the only one for blank and repeated rows); Insert
an empty turn before any row or at the end (2); a truncated row that isn't deleted costs 1 more. Of the cheapest edit
sequences the one whose initials are least in ASCII order is taken.

The search is iterative-deepening A*: depth first, edits in ASCII order (D, I, K, R), under a bound on the cost so far
plus a lower bound on the rest. The lower bound is what faulty rows cost at least; a state (row, place in the grammar)
that failed keeps, in a transposition table, the least that it then needs, and the next bound comes from the table. An
edit leads from a state to one state only, so the first path accepted is the answer.

A conversation may hold a large part of all rows. Rows are sorted by ranges, and cut into tiles of at most `tile_rows`
rows, each a task's work of its own. Of conversations of several tiles, each tile is searched for its least cost
between any two places of the grammar; a scan over these small tables from the back gives each tile what the rest
costs after it; with that each tile finds its answer from any place it may start in, and a scan from the front picks
the one it does start in. The answers are those of one search over the whole conversation.

Defined results: rows of one turn stand in the order of role and text, repeated rows next to each other; null roles and
texts are one space, null turns come first; null conv_ids are one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Places in the grammar: nothing yet, behind s, behind u, behind a.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
PLACES = 4
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
#: What an inserted or changed row becomes at each place, and what the end costs there: the turns still to insert.
ROLE = ("user", "user", "assistant", "user")
MISSING = (0, 2, 1, 0)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
END = tuple(float(INSERT * k) for k in MISSING)
NEVER = float("inf")
#: A row's fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = " \t\n\x0b\x0c\r"


# --- search ---


@dataclass(frozen=True)
class Found:
    cost: float
    audit: str
    end: int


def _moves(initial: str, fault: int, place: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows consumed, place after) in ASCII order."""
    yield "D", DELETE, 1, place
    wanted = ROLE[place][0]
    yield "I", INSERT, 0, NEXT[place][wanted]
    if fault in (SOUND, TRUNCATED):
        extra = CUT if fault == TRUNCATED else 0
        if initial in NEXT[place]:
            yield "K", KEEP + extra, 1, NEXT[place][initial]
        if initial != wanted:
            yield "R", REROLE + extra, 1, NEXT[place][wanted]


def search(rows: list[tuple[str, int]], start: int = EMPTY, after: tuple[float, ...] = END) -> Found | None:
    """The cheapest edits of rows (role's initial, fault) from a place of the grammar, whose end at a place costs `after` more; None if there are none.

    Inserts stand before the row that follows; what is missing at the end isn't part of the edits.
    """
    n = len(rows)
    rest = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (0, DELETE, DELETE, CUT)[rows[i][1]]
    least_after = min(after)
    most = DELETE * n + INSERT * PLACES + max((x for x in after if x < NEVER), default=-NEVER)
    moves = [[tuple(_moves(*row, place)) for place in range(PLACES)] for row in rows]
    needs: dict[tuple[int, int], float] = {}

    def need(i: int, place: int) -> float:
        """The least that the rest can cost: learned where a search failed, else that of the faults ahead."""
        return after[place] if i == n else needs.get((i, place), rest[i] + least_after)

    def visit(i: int, place: int, left: float) -> list[str] | None:
        """The first path from here that costs at most `left`, its edits from the last; without one, what is needed is learned."""
        if i == n:
            return [] if after[place] <= left else None
        best = NEVER
        for edit, cost, step, to in moves[i][place]:
            if need(i + step, to) <= left - cost:
                path = visit(i + step, to, left - cost)
                if path is not None:
                    path.append(edit)
                    return path
            best = min(best, cost + need(i + step, to))
        needs[i, place] = max(best, need(i, place))
        return None

    bound = need(0, start)
    while bound <= most:
        path = visit(0, start, bound)
        if path is not None:
            audit = "".join(reversed(path))
            end = walk(rows, start, audit)[1]
            return Found(bound - after[end], audit, end)
        bound = need(0, start)
    return None


def walk(rows: list[tuple[str, int]], start: int, audit: str) -> tuple[list[tuple[int | None, str | None]], int]:
    """What edits leave, as (row or None, new role or None), and the place of the grammar behind them."""
    out, place, i = [], start, 0
    for edit in audit:
        role = ROLE[place]
        if edit == "K":
            out.append((i, None))
            place = NEXT[place][rows[i][0]]
        elif edit != "D":
            out.append((None if edit == "I" else i, role))
            place = NEXT[place][role[0]]
        i += edit != "I"
    return out, place


# --- Spark ---


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by a hash of `conv_id:turn`; a dropped one stays, not present, for its conversation's sake."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(named(conv_col), F.lit(":"), named(turn_col)).cast("binary")) % 20
    role, text = named(role_col), named(text_col)
    out = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (h != 0).alias("present"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """rows (at, conv_id, role, text, present, …) with the first fault of each; a repeated row is one whose at isn't the first of its kind."""
    first = rows.where("present").groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.join(first, "at", "left").withColumn("fault", fault).drop("first")


def _each(df: DataFrame, names: list[str], schema: str, make: Callable[[dict], dict]) -> DataFrame:
    """make over the rows of df (some columns of which pass through unchanged, by name), batch by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 500):
                made = [make(r) for r in b.slice(low, 500).to_pylist()]
                yield pa.RecordBatch.from_pylist(made, schema=kinds)

    kinds = _arrow(df, names, schema)
    return df.mapInArrow(run, _ddl(df, names, schema))


def _ddl(df: DataFrame, names: list[str], schema: str) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n in names), schema])


def _arrow(df: DataFrame, names: list[str], schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(_ddl(df, names, schema)))


def _scan(df: DataFrame, back: bool, schema: str, begin: tuple | int, step: Callable) -> DataFrame:
    """(low, …): a fold along the tiles of each conversation of df (conv_id, low, …), which gives what step had before a tile; one pass over sorted rows, of which none are gathered."""
    names = ["low", schema.split(" ", 1)[0]]
    order = F.desc("low") if back else F.asc("low")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, any_row = None, begin, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not any_row or r["conv_id"] != conv:
                    conv, state, any_row = r["conv_id"], begin, True
                out.append({"low": r["low"], names[1]: list(state) if isinstance(state, tuple) else state})
                state = step(state, r)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("low", pa.int64()), (names[1], pa.list_(pa.float64()) if "array" in schema else pa.int32())])
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, f"low bigint, {schema}")


def _pairs(r: dict) -> list[tuple[str, int]]:
    return [(x["role"][:1], x["fault"]) for x in r["rows"]]


def _costs(r: dict) -> dict:
    """Least costs of a tile between any two places, row by row of starts."""
    rows, out = _pairs(r), []
    for start in range(PLACES):
        for end in range(PLACES):
            found = search(rows, start, tuple(0.0 if e == end else NEVER for e in range(PLACES)))
            out.append(found.cost if found else NEVER)
    return {"conv_id": r["conv_id"], "low": r["low"], "costs": out}


def _before(rest: tuple, r: dict) -> tuple:
    c = r["costs"]
    return tuple(min(c[PLACES * s + e] + rest[e] for e in range(PLACES)) for s in range(PLACES))


def _ends(r: dict) -> dict:
    rows, after = _pairs(r), tuple(r["after"])
    found = [search(rows, s, after) for s in range(PLACES)]
    return {"conv_id": r["conv_id"], "low": r["low"], "ends": [f.end if f else EMPTY for f in found]}


def _answer(r: dict) -> dict:
    rows, start, after = _pairs(r), r["start"] or EMPTY, tuple(r["after"] or END)
    found = search(rows, start, after)
    out, end = walk(rows, start, found.audit)
    repaired = [{"role": role or r["rows"][i]["role"], "text": "" if i is None else r["rows"][i]["text"]} for i, role in out]
    audit, cost = found.audit, found.cost
    if r["last"]:
        audit, cost = audit + "I" * MISSING[end], cost + END[end]
        for _ in range(MISSING[end]):
            repaired.append({"role": ROLE[end], "text": ""})
            end = NEXT[end][ROLE[end][0]]
    faults = [f for _, f in rows]
    legal = {"su", "ua", "au"}
    illegal = sum(a[0] + b[0] not in legal for a, b in zip(rows, rows[1:]))
    return {"conv_id": r["conv_id"], "low": r["low"], "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal, "cost": int(cost), "audit": audit, "repaired": repaired}


@dataclass(frozen=True)
class Repair:
    """rows: (conv_id, turn, role, text, present), those that were searched; tiles: (conv_id, low, first, last, blank, duplicate, truncated, illegal, cost, audit, repaired), in the order of low, illegal ones between a tile and the one before included."""

    rows: DataFrame
    tiles: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, low, k, role, text): the repaired turns, in the order of low and k."""
        return self.tiles.select("conv_id", "low", F.posexplode("repaired").alias("k", "r")).select("conv_id", "low", "k", "r.role", "r.text")


def repair(rows: DataFrame, tile_rows: int = 64) -> Repair:
    """Repair of rows (conv_id, turn, role, text[, present]); rows that aren't present only name their conversation. tile_rows is a power of two."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), "present")
    # Sorted by ranges: a large conversation spans many partitions. Row numbers follow the order.
    split = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = materialise(split.withColumn("at", F.monotonically_increasing_id()), "turns")
    row = F.when(F.col("present"), F.struct("at", "role", "text", "fault"))
    tiles = _faults(ordered).groupBy("conv_id", F.shiftright("at", tile_rows.bit_length() - 1).alias("tile")).agg(F.min("at").alias("low"), F.array_sort(F.collect_list(row)).alias("rows"))
    tiles = materialise(tiles.drop("tile"), "tiles")
    initial: Callable[[int], Column] = lambda k: F.try_element_at("rows", F.lit(k))["role"].substr(1, 1)
    along = Window.partitionBy("conv_id").orderBy("low")
    light = tiles.select("conv_id", "low", initial(1).alias("a"), initial(-1).alias("b"))
    before = F.last("b", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    light = light.select("low", F.lag("low").over(along).isNull().alias("first"), F.lead("low").over(along).isNull().alias("last"), (~F.concat(before, "a").isin("su", "ua", "au")).alias("odd"))
    marked = materialise(light.select("low", "first", "last", F.coalesce("odd", F.lit(False)).cast("int").alias("odd")), "tile-places")
    several = marked.where("NOT (first AND last)").select("low")
    own = tiles.join(several, "low", "left_semi").select("conv_id", "low", "rows")
    costs = _each(own, ["conv_id", "low"], "costs array<double>", _costs)
    after = materialise(_scan(costs, True, "after array<double>", END, _before), "tile-rest")
    ends = _each(own.join(after, "low").select("conv_id", "low", "rows", "after"), ["conv_id", "low"], "ends array<int>", _ends)
    start = _scan(ends, False, "start int", EMPTY, lambda place, r: r["ends"][place])
    joined = tiles.join(marked, "low").join(after, "low", "left").join(start, "low", "left").select("conv_id", "low", "rows", "after", "start", "last")
    answers = _each(joined, ["conv_id", "low"], "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role: string, text: string>>", _answer)
    answers = answers.join(marked.select("low", "first", "last", "odd"), "low").withColumn("illegal", F.col("illegal") + F.col("odd")).drop("odd")
    return Repair(ordered.drop("at"), answers)


def summary(of: Repair) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    audit and the hash are of whole conversations, so here, and only here, a conversation's texts meet.
    """
    turns = of.rows.withColumn("turn", F.when(F.col("present"), F.col("turn"))).groupBy("conv_id", "turn").agg(F.lit(1).alias("n"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    pieces = of.tiles.withColumn("text", F.when(F.size("repaired") > 0, text))
    together = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("low", c)))), lambda x: x[c]), by)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], together("audit", "").alias("audit"), F.sha2(together("text", "\n").cast("binary"), 256).alias("repaired_sha256"))
    g = gaps.withColumnRenamed("conv_id", "__c")
    return whole.join(g, F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", "gaps", *counts, "audit", "repaired_sha256")
