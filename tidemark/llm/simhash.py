"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints (64 bits over word shingles) are cut into `blocks` blocks. Two fingerprints that differ in at
most `distance` bits agree on at least `blocks - distance` whole blocks, so every link shares one of the
C(blocks, blocks - distance) block combinations. Rows are dealt by combination and value, compared there by
XOR and bit count, and the verified links are closed into components.

Equal fingerprints are collapsed before the join, a bucket's links leave its task as a star (never all its
pairs), and a bucket of more than `bucket_rows` fingerprints is dealt out as pairs of chunks, so no task
holds an unbounded bucket and no link is lost.

`similar` and `keep_one` take five-word shingles and a similarity of 0.8, where pairs differ in some 15 % of their bits.
No cut of 64 bits into whole blocks shares one then, so their fingerprints have 256 bits and their blocks are sampled
from these, as many as the number of texts asks for. Blocks and Hamming distance find families, within which every pair
that the distance leaves open is decided by its shingles, in tasks of bounded size.

Defined results: null text and texts without words have fingerprint 0, which links like any other; repeated
rows share their component; a null id never names a component unless all of its ids are null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

SEED = 42
#: Bits of a wide fingerprint.
WIDE = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _shingles(text: bytes, shingle: int) -> list[bytes]:
    """A text's word shingles, A-Z lower-cased, repeats included; the whole sequence if it has fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    return [line[a:b] for a, b in zip(starts, last)]


def _majority(digests: bytes, n: int) -> bytes:
    """Of n hashes of equal width, the bits that over half of them have."""
    hashes = np.frombuffer(digests, np.uint8).reshape(n, -1)
    wide = 8 * hashes.shape[1]
    counts = np.zeros(wide, np.int64)
    for low in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[low : low + 255 * 64], axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, wide).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the XXH64 of a text's word shingles; a bit is 1 if over half of the hashes have it."""
    found = _shingles(text, shingle)
    digest = xxhash.xxh64_digest
    return int.from_bytes(_majority(b"".join([digest(x, SEED) for x in found]), len(found)), "big") if found else 0


def wide_fingerprint(text: bytes, shingle: int = 5) -> bytes:
    """SimHash of WIDE bits, from two 128-bit hashes of each word shingle; zero without a word."""
    found = _shingles(text, shingle)
    digest = xxhash.xxh3_128_digest
    return _majority(b"".join([digest(x, s) for x in found for s in (SEED, SEED + 1)]), len(found)) if found else bytes(WIDE // 8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a bigint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=[id_col, "fp"])

    ids = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return ids.mapInArrow(run, f"`{id_col}` {dict(ids.dtypes)[id_col]}, fp bigint")


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask of bits for each choice of blocks - distance blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(each, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between positions as (member, smallest of its part), one for each member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(fp[a].tolist(), fp[b].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _compare(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs in one group (equal ones are adjacent) with at most `distance` differing bits, as stars."""
    found_a, found_b = [], []
    bits = fp.view(np.uint64)
    at = np.arange(len(fp) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= distance]
        found_a.append(near)
        found_b.append(near + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    return _stars(fp, a, b)


def links(distinct: DataFrame, distance: int = 3, blocks: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """(a, b), a > b: links between the fingerprints in column fp, enough of them to connect all that are linked."""
    masks = block_masks(blocks, distance)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["part", "key"])
    # A bucket of c chunks: a fingerprint of chunk x goes to each pair of chunks that has x.
    c = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    dealt = (
        shared.withColumn("c", c)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select(F.xxhash64("part", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = ["a", "b"]
        for batch in batches:
            g = np.concatenate([g, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _compare(fp[:cut], g[:cut], distance)], names=names)
            g, fp = g[cut:], fp[cut:]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _compare(fp, g, distance)], names=names)

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that it reaches.

    Large-star and small-star rounds until nothing changes; each round is a written table. A node's neighbours
    are only ever reduced to their minimum, never gathered.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    for _ in range(most_rounds):
        if not now[0]:
            break
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = materialise(small, "edges")
        last, now = now, state(edges)
        if now == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp): fp is the wide fingerprint, a binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [wide_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], names=[id_col, "fp"])

    ids = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return ids.mapInArrow(run, f"`{id_col}` {dict(ids.dtypes)[id_col]}, fp binary")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> DataFrame:
    """(id, shingles): the distinct 64-bit hashes of a text's word shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                found = {xxhash.xxh3_64_intdigest(x, SEED) for x in _shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle)}
                hashes = np.fromiter(found, np.uint64, len(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.column(0).type), pa.array([hashes], pa.list_(pa.int64()))], names=[id_col, "shingles"])

    ids = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return ids.mapInArrow(run, f"`{id_col}` {dict(ids.dtypes)[id_col]}, shingles array<bigint>")


def sampled_keys(fp: np.ndarray, keys: int, key_bits: int) -> np.ndarray:
    """(n, keys): the values of `keys` blocks of `key_bits` bits each, drawn once for all data from a fingerprint's bits (n, WIDE)."""
    draw = np.random.default_rng(SEED)
    weight = 1 << np.arange(key_bits, dtype=np.int64)
    return np.stack([(fp[:, draw.choice(WIDE, key_bits, replace=False)] @ weight) + (k << 32) for k in range(keys)], axis=1)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of differing bits of wide fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(fp: np.ndarray, group: np.ndarray, certain: int, distance: int, small: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure): links that span what pairs of at most `distance` bits connect within each group of equal, adjacent `group`.

    The sure ones alone span what pairs of at most `certain` bits connect. Groups of up to `small` rows are compared pair
    by pair, all at once. A larger one is searched breadth first: a row is compared only with rows that no part has
    reached yet, so a group of copies costs its length and not its square. Either way what is connected is the same.
    """
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    at = np.flatnonzero(np.repeat(sizes <= small, sizes))
    found = [[np.zeros(0, np.int64)] for _ in range(3)]
    step = 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        d = _bits(fp[at], fp[at + step])
        for x, y in zip(found, (at[d <= distance], at[d <= distance] + step, d[d <= distance])):
            x.append(y)
        step += 1
    a, b, d = map(np.concatenate, found)
    order = np.argsort(d > certain, kind="stable")
    pairs = [zip(a[order].tolist(), b[order].tolist(), (d[order] <= certain).tolist())]
    for k in np.flatnonzero(sizes > small):
        for family in _reached(fp, np.arange(edges[k], edges[k + 1]), distance):
            parts = _reached(fp, family, certain) if len(family) > 1 else []
            pairs += [zip([int(p[0])] * (len(p) - 1), p[1:].tolist(), [True] * (len(p) - 1)) for p in parts]
            pairs.append([(int(parts[0][0]), int(p[0]), False) for p in parts[1:]])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used = []
    for i, j, sure in itertools.chain(*pairs):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append((i, j, sure))
    return np.array([u[0] for u in used], np.int64), np.array([u[1] for u in used], np.int64), np.array([u[2] for u in used], bool)


def _reached(fp: np.ndarray, rows: np.ndarray, distance: int) -> list[np.ndarray]:
    """The rows in the parts that pairs of at most `distance` bits connect."""
    out = []
    while len(rows):
        part, queue, rows = [rows[:1]], [int(rows[0])], rows[1:]
        while queue and len(rows):
            near = _bits(fp[rows], fp[queue.pop()]) <= distance
            part.append(rows[near])
            queue += rows[near].tolist()
            rows = rows[~near]
        out.append(np.concatenate(part))
    return out


def wide_links(distinct: DataFrame, distance: int, certain: int, keys: int, key_bits: int, bucket_rows: int) -> DataFrame:
    """(a, b, sure), a > b: links that connect the rows (node, fp) of distinct that share a sampled block and differ in at most `distance` bits; sure: in at most `certain`, or by such steps."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1).astype(np.int64)
                key = sampled_keys(bits, keys, key_bits)
                again = np.repeat(np.arange(part.num_rows), keys)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column(0).take(pa.array(again)), part.column(1).take(pa.array(again))], names=["key", "node", "fp"])

    keyed = distinct.select("node", "fp").mapInArrow(blocks, "key bigint, node bigint, fp binary")
    # A bucket of c chunks: a row of chunk x goes to each pair of chunks that has x. Most buckets are one chunk.
    # Written, so that the planner knows its size, and broadcasts it only if small.
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows), "hot")
    c = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(bucket_rows)).cast("int")
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("c", c)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "fp")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, node, fp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE // 64), np.uint64)

        def found(upto: int) -> pa.RecordBatch:
            a, b, sure = _forest(fp[:upto], g[:upto], certain, distance)
            a, b = node[:upto][a], node[:upto][b]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.maximum(a, b), np.minimum(a, b), sure)], names=["a", "b", "sure"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.concatenate([g, batch.column(0).to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column(1).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE // 64)])
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            yield found(cut)
            g, node, fp = g[cut:], node[cut:], fp[cut:]
        yield found(len(g))

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint, sure boolean").distinct()


def _decided(part: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (part, part) between rows of different parts, one of which asks, whose sets have a Jaccard similarity of at least `least`.

    An index from members to rows counts what a row shares with all others at once.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = set()
    for k in np.flatnonzero(asks & (size > 0)).tolist():
        low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = (both >= least * (size[k] + size - both)) & (part != part[k])
        out.update((max(p, int(part[k])), min(p, int(part[k]))) for p in part[near].tolist())
    return list(out)


def _part_links(members: DataFrame, sets: DataFrame, least: float, chunk_rows: int, chunk_shingles: int) -> DataFrame:
    """(a, b): parts of a family of which two rows are similar, of members (node, part, family) and sets (node, shingles).

    Rows of a family's largest part meet the others only, as its own need no decision; the others also meet each other.
    Both are dealt out as chunks of bounded rows and shingles, and a task has two chunks at a time.
    """
    sized = materialise(members.join(sets.select("node", F.size("shingles").alias("n")), "node"), "members")
    parts = sized.groupBy("family", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    whole = parts.groupBy("family").agg(F.max(F.struct("rows", "part")).alias("top"), F.max_by("n", F.struct("rows", "part")).alias("top_n"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    chunks = lambda rows, n: F.greatest(F.ceil(rows / F.lit(chunk_rows)), F.ceil(n / F.lit(chunk_shingles)), F.lit(1)).cast("int")
    whole = materialise(whole.select(F.col("family").alias("f"), F.col("top.part").alias("top"), chunks(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top_n")).alias("q"), chunks(F.col("top.rows"), F.col("top_n")).alias("l")), "families")
    own = sized.join(whole, F.col("family") == F.col("f")).withColumn("asks", F.col("part") != F.col("top"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("q")).otherwise(F.col("l"))).cast("int")
    numbers = lambda upto: F.sequence(F.lit(0), F.col(upto) - 1)
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    with_others = F.transform(numbers("q"), lambda k: place(0, F.least("own", k), F.greatest("own", k)))
    with_top = F.transform(numbers("l"), lambda k: place(1, F.col("own"), k))
    of_top = F.transform(numbers("q"), lambda k: place(1, k, F.col("own")))
    dealt = own.withColumn("own", mine).withColumn("p", F.explode(F.when(F.col("asks"), F.concat(with_others, with_top)).otherwise(of_top)))
    dealt = dealt.select("node", "part", "asks", F.xxhash64("family", "p.kind", "p.i", "p.j").alias("g")).join(sets, "node").select("g", "part", "asks", "shingles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, np.ndarray]] = []
        last = None

        def found() -> pa.RecordBatch:
            links = _decided(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], bool), [h[2] for h in held], least) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            values, offsets = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            for k, (g, part, asks) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if g != last:
                    yield found()
                    held, last = [], g
                held.append((part, asks, values[offsets[k] : offsets[k + 1]].copy()))
        yield found()

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint").distinct()


def _classes(first: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(fp, component) of first (fp, first, node column): the smallest first of all that roots (node, root) put together."""
    rooted = first.join(roots.withColumnRenamed("node", "member"), F.col(node) == F.col("member"), "left").select("fp", "first", F.coalesce("root", node).alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return materialise(rooted.join(least, "root").select("fp", "component"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, blocks: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """(id, fp, component): component is the smallest id of the documents that links reach, its own included."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(first.select("fp"), distance, blocks, bucket_rows))
    return prints.join(_classes(first, roots, "fp"), "fp").select(id_col, "fp", "component")


def blocks_for(rows: int, similarity: float = 0.8, recall: float = 0.97) -> tuple[int, int]:
    """(keys, key_bits) for some number of texts: blocks of as many bits as tell them apart, 18 at least, and so many that a pair of the similarity shares one with the probability `recall`."""
    key_bits = min(WIDE, max(18, math.ceil(math.log2(max(2, rows)))))
    same = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** key_bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same)), key_bits


def similar(rows: DataFrame, row_col: str, key: Column, text_col: str = "text", shingle: int = 5, least: float = 0.8, distance: int = 56, certain: int = 24, keys: int | None = None, key_bits: int | None = None, bucket_rows: int = 4096, chunk_rows: int = 512, chunk_shingles: int = 2_000_000) -> DataFrame:
    """(fp, component), one row for each distinct wide fingerprint: the smallest key of its class.

    Classes are closed over links between texts whose sets of `shingle` words have a Jaccard similarity of at least
    `least`; row_col is a unique bigint. Of two texts of similarity j a bit differs with probability
    acos(2 j / (1 + j)) / pi: 38.8 of 256 bits at 0.8, with a deviation of 5.7. So pairs of at most `certain` bits are
    links; pairs of up to `distance` that share a block make families. Within a family every two texts that the first
    rule hasn't linked are compared by their shingles, whatever the sizes of blocks and families. Blocks are those of
    blocks_for unless given: a pair at 0.8 shares one with a probability of 0.97, from 0.85 on of over 0.99.
    """
    prints = wide_fingerprints(rows.select(F.struct(key.alias("key"), F.col(row_col).alias("row")).alias("id"), text_col), "id", text_col, shingle)
    first = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")).select("fp", F.col("first.key").alias("first"), F.col("first.row").alias("node")), "fingerprints")
    own_keys, own_bits = blocks_for(first.count(), least)
    found = materialise(wide_links(first, distance, certain, keys or own_keys, key_bits or own_bits, bucket_rows), "links")
    sure = components(found.where("sure").select("a", "b")).withColumnRenamed("root", "part")
    of = lambda df, node, part: df.join(sure.select(F.col("node").alias(f"__{node}"), F.col("part").alias(part)), F.col(node) == F.col(f"__{node}"), "left").withColumn(part, F.coalesce(part, node)).drop(f"__{node}")
    open_ = of(of(found.where("NOT sure").select("a", "b"), "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
    families = components(open_).select(F.col("node").alias("part"), F.col("root").alias("family"))
    members = materialise(of(first.select("node"), "node", "part").join(families, "part"), "families")
    sets = materialise(shingle_sets(rows.select(F.col(row_col).alias("node"), text_col).join(members.select("node"), "node", "left_semi"), "node", text_col, shingle), "shingles")
    parts = components(_part_links(members, sets, least, chunk_rows, chunk_shingles)).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    roots = of(first.select("node"), "node", "part").join(parts, "part", "left").select("node", F.coalesce("whole", "part").alias("root"))
    return _classes(first, roots, "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of `similar`: one of the smallest id, null ids last.

    Rows are told apart by a number written with them, so ids may repeat or be null. Texts without words are one class.
    """
    row = "__row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    kept = similar(rows, row, key, text_col, **options).select(F.col("component.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
