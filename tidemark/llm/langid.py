"""Language identification by a byte convolutional network trained and run in numpy.

Text bytes (lower-cased ASCII) are embedded, filters of several widths run over fixed-length windows, each filter's
largest response in a window passes to a softmax over the learned languages. A text's windows are dealt without
gaps over the whole text and their probabilities are averaged by length.

Trained by Adam on windows of labelled texts that are not held out. The fit runs on the driver, on at most
`Config.train_rows` labelled rows with a letter, the ones of smallest hash; that bound is the only sample. The scores run in batches
within the scan: no shuffle, and work arrays of bounded size.

Inference folds each embedding into its filters: a filter of width w is a sum of w table rows, so a window costs
look-ups instead of products.

Defined results: `und` with score 0 for null texts and texts without a letter; ties go to the language that sorts
first; repeated rows give repeated results; with no usable labelled row everything is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, portions, utf8

UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[*range(0x20)]] = 0x20
#: Unicode's letters; numerals such as a superscript two are none.
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Config:
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 8
    #: Labelled rows that the fit may use at most, and windows of each of them.
    train_rows: int = 6000
    train_windows: int = 3
    epochs: int = 6
    batch: int = 128
    rate: float = 0.004
    seed: int = 7


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts laid end to end as an array of bytes padded with spaces; the text and the bytes of each."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + nth * size
    used = np.minimum(size, offsets[1:][owner] - start)
    padded = np.concatenate([_FOLD[data], np.full(size, 0x20, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, size)[start]
    short = np.flatnonzero(used < size)
    out[short] = np.where(np.arange(size) < used[short, None], out[short], 0x20)
    return out, owner, used


class Network:
    """Embedding, filters of several widths with ReLU and max pooling, and a softmax."""

    def __init__(self, config: Config, langs: list[str]) -> None:
        rng = np.random.default_rng(config.seed)
        self.config, self.langs = config, langs
        e, f = config.embedding, config.filters
        self.p = {"emb": rng.normal(0, 0.3, (256, e)), "out": rng.normal(0, 0.1, (f * len(config.widths), len(langs))), "bias": np.zeros(len(langs))}
        for w in config.widths:
            self.p[f"w{w}"] = rng.normal(0, (w * e) ** -0.5, (w * e, f))
            self.p[f"b{w}"] = np.zeros(f)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p, c = self.p, self.config
        n, size = x.shape
        emb = p["emb"][x]
        pooled, kept = [], []
        for w in c.widths:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, size - w + 1, -1)
            z = cols @ p[f"w{w}"] + p[f"b{w}"]
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((cols, best, top > 0))
        h = np.concatenate(pooled, axis=1)
        probs = self._softmax(h)
        loss = float(-np.log(probs[np.arange(n), y] + 1e-9).mean())
        dz = probs.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"out": h.T @ dz, "bias": dz.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        dh = dz @ p["out"].T
        rows = np.arange(n)[:, None]
        for k, (w, (cols, best, on)) in enumerate(zip(c.widths, kept)):
            d = dh[:, k * c.filters : (k + 1) * c.filters] * on
            picked = cols[rows, best]  # n, filters, w * e
            g[f"w{w}"] = np.einsum("nfk,nf->kf", picked, d)
            g[f"b{w}"] = d.sum(axis=0)
            back = np.einsum("nf,kf->nfk", d, p[f"w{w}"]).reshape(n, c.filters, w, c.embedding)
            for i in range(w):
                np.add.at(g["emb"], x[rows, best + i], back[:, :, i])
        return g, loss

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        c, rng = self.config, np.random.default_rng(self.config.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(c.epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), c.batch):
                at = order[low : low + c.batch]
                g, _ = self.gradients(x[at], y[at])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (c.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._fold()
        return self

    def _fold(self) -> None:
        """tables[i]: what a byte adds, as the i-th of a filter's bytes, to the filters of width over i, widths ascending from the end."""
        e = self.config.embedding
        self.order = sorted(self.config.widths)
        self.tables = [np.ascontiguousarray(np.concatenate([self.p["emb"] @ self.p[f"w{w}"][i * e : (i + 1) * e] for w in self.order if w > i], axis=1)) for i in range(self.order[-1])]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window; all filters' responses are sums of table rows."""
        f, size = self.config.filters, x.shape[1]
        z = np.take(self.tables[0], x, axis=0, mode="clip")
        for i, t in enumerate(self.tables[1:], 1):
            z[:, : size - i, z.shape[2] - t.shape[1] :] += np.take(t, x[:, i:], axis=0, mode="clip")
        pooled = {w: z[:, : size - w + 1, k * f : (k + 1) * f].max(axis=1) for k, w in enumerate(self.order)}
        return self._softmax(np.concatenate([np.maximum(pooled[w] + self.p[f"b{w}"], 0) for w in self.config.widths], axis=1))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and its probability for each text."""
        data, offsets = utf8(texts)
        n = len(offsets) - 1
        total = np.zeros((n, len(self.langs)))
        x, owner, used = windows_of(data, offsets, self.config.window)
        if len(x):
            part = np.concatenate([self.probabilities(x[low : low + 128]) for low in range(0, len(x), 128)]) * used[:, None]
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(owner, part[:, k], minlength=n)
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
        best = total.argmax(axis=1)
        known = [t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, total.max(axis=1), 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", config: Config = Config()) -> Network | None:
    """A network fitted to labelled rows of docs outside the held-out fold; None where there are none."""
    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    usable = columns.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Windows taken evenly from each whole text, of the rows of smallest hash: only those windows travel. A bound on
    # the hash keeps tasks from sending train_rows each: the lowest of the halved ones that train_rows usable rows, or
    # all of them, pass.
    size, k = config.window, config.train_windows
    bounds = [2 ** (64 - i) - 2**63 - 1 for i in range(41)]
    passed = usable.agg(*[F.count_if(F.col("h") <= b).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
    most = min(b for b, n in zip(bounds, passed) if n >= min(config.train_rows, passed[0]))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(F.col("text"), (i * F.greatest(F.length("text") - size, F.lit(0)) / max(1, k - 1)).cast("int") + 1, F.lit(size)))
    chosen = usable.select("lang", F.array_distinct(spread).alias("parts"), "h").where(F.col("h") <= most).orderBy("h", "lang", "parts").limit(config.train_rows)
    rows = chosen.select("lang", F.explode("parts").alias("part")).where(F.col("part").rlike(r"\p{L}")).collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    net = Network(config, langs)
    parts = [r["part"].encode()[:size] for r in rows]
    data = np.frombuffer(b"".join(parts), np.uint8)
    x, _, _ = windows_of(data, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), size)
    return net.fit(x, np.array([langs.index(r["lang"]) for r in rows]))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each document."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, "text", 1_000_000)):
            lang, score = held.value.predict(batch.column(1)) if held.value else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, f"id {dict(ids.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, net: Network | None, least_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """docs whose language is known with at least least_score; within the scan, all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, text_col, 1_000_000)):
            if held.value:
                lang, score = held.value.predict(batch.column(at))
                yield batch.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_held_out_fold(id_col: str = "doc_id") -> Column:
    return held_out(F.col(id_col))
