"""Toxicity of texts whose words may be disguised: a noisy channel is undone, then the restored text is scored.

Words that could be disguised (look-alike signs, a letter twice or more in a row, letters set apart by spaces or
signs) become lattices: each sign may be itself, a letter that it looks like or nothing, a repeated letter may stand
once, twice or as often as it does, and between letters set apart there may be a word's end. Viterbi finds the cheapest
path under a trigram language model of characters and fixed costs of the channel, in time linear in the length, so
fields and runs of any length are decoded. The model's counts come from the words of all documents, added up in one
pass of fixed-size histograms. Numbers (fields of digits alone) are numbers and aren't decoded. Texts are folded first:
compatibility forms (full-width letters and the like) are replaced, signs without a width go; letters of other scripts
that look like Latin ones are signs of the lattice, which may also be themselves.

Restored words are scored by evidence: hashed words and word beginnings are counted in labelled documents of each
class (of the folds that may be learned from, the first two), as log odds; a text's strongest evidence and its share
of toxic words go through a logistic regression fitted to the other fold. In letters set apart, singly or in pairs, the
ends of words are lost: a second Viterbi pass finds the cheapest sequence of words, of those most frequent in the
labelled texts by their frequency and of others by the character model, and only its known words count as evidence. Words,
counts and the regression are learned from all labelled rows outside the held-out fold: labels are joined to texts by a
shuffle, and each Newton step adds up its sums over all rows of a written table. Everything that is broadcast, and all
that the driver gets, has a bounded size.

Defined results: null and empty texts and texts without evidence get the fitted base score; repeated rows give
repeated results; with no usable labels every score is 0; null labels are no labels; labelled ids that occur several
times count once for each row of theirs.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FOLDS, HELD_OUT, materialise

#: Signs, and the letters that they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", ".": "", "-": "", "_": "", "'": "",
}
#: Letters of other scripts, and the Latin ones that they look like.
HOMOGLYPHS = dict(zip("аеорсхуіјѕԁһӏкмтвнαορντικυ", "aeopcxyijsdhlkmtbhaopvtiku", strict=True))
LOOKALIKES |= HOMOGLYPHS
_SIGNS = re.escape("".join(LOOKALIKES))
#: Signs without a width.
_WIDTHLESS = re.compile("[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
#: Letters of the model: 0 stands for a word's edge and all other letters are the last.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßàáâçèéêëìíîïñòóôùúûœæ"
_A = len(_ALPHABET) + 2
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}+")
#: In a field that may hide a word: a sign next to a letter, a letter twice in a row, or look-alike signs alone.
_ODD = re.compile(rf"[{_SIGNS}]{_LETTER}|{_LETTER}[{_SIGNS}]|({_LETTER})\1|^(?=.*[^0-9])(?!(.)\2+$)[{_SIGNS}]{{3,}}$", re.DOTALL)
_SIGN = re.compile(rf"[{_SIGNS}\W\d]")
_RUN = re.compile(r"(.)\1*")
_OUTER = re.compile(r"^(?:([^\w\s])\1+)|(?:([^\w\s])\2+)[.,;:!?]*$|^[\"'(\[]+|[.,;:!?\"')\]]+$")


@dataclass(frozen=True)
class Config:
    bins: int = 1 << 18
    #: Lengths of word beginnings that are features beside the whole word.
    beginnings: tuple[int, ...] = (4, 5, 6)
    smoothing: float = 0.5
    threshold: float = 0.3
    #: Costs of the channel, in nats: a sign as a letter it looks like, one dropped that looks like a letter or not, a repeated letter shortened.
    as_letter: float = 0.5
    dropped: float = 8.0
    set_apart: float = 1.0
    shortened: float = 0.7
    #: A word's end between letters set apart.
    ended: float = 0.0
    #: Fields of one or two characters in a row that are letters set apart, at least; the longest words that they may be, how
    #: many of the labelled texts' frequent words are known, and what a word that isn't among them costs besides its letters.
    run: int = 3
    word: int = 20
    words: int = 100_000
    unknown: float = 4.0
    cache: int = 400_000


# --- character language model ---


_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point below 0x250: its model code if it is a letter of the model, else 0."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.zeros(0x250, np.uint8)
        for c, i in _CODE.items():
            if ord(c) < 0x250:
                _LETTERS[ord(c)] = i
                if len(c.upper()) == 1 and ord(c.upper()) < 0x250:
                    _LETTERS[ord(c.upper())] = i
    return _LETTERS


def trigram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of letter trigrams in the words of some texts, edges included, as one array of _A ** 3 bins."""
    joined = " ".join(t for t in texts.to_pylist() if t)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    code = np.where(points < 0x250, _letter_table()[np.minimum(points, 0x24F)], 0).astype(np.int32)
    code = np.concatenate([[0, 0], code, [0, 0]]).astype(np.int32)
    worth = (code[1:-1] > 0) | (code[:-2] > 0)  # the last two of a trigram aren't both outside words
    index = ((code[:-2] * _A + code[1:-1]) * _A + code[2:])[worth]
    return np.bincount(index, minlength=_A**3)


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents: each task sends its non-empty bins once, of which there are _A ** 3 at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_A**3, np.int64)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                total += trigram_counts(b.column(0).slice(low, 256))
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(total[bins], pa.int64())], names=["bin", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_A**3, np.int64)
    out[counted.column("bin").to_numpy()] = counted.column("n").to_numpy()
    return out


def fold(text: str) -> str:
    """A text without compatibility forms and signs without a width."""
    if text.isascii():
        return text
    if _WIDTHLESS.search(text):
        text = _WIDTHLESS.sub("", text)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def frequent_words(texts: DataFrame, most: int) -> dict[str, int]:
    """The `most` most frequent words of rows (text), lower-case, with their counts; ties go by the word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 2048):
                fields = pc.utf8_split_whitespace(pc.utf8_lower(b.column(0).slice(low, 2048).drop_null())).flatten().value_counts()
                # Fields without what surrounds their word; those that are more than a word are left out.
                words: Counter[str] = Counter()
                for field, n in zip(fields.field(0).to_pylist(), fields.field(1).to_pylist()):
                    found = _WORD.findall(field)
                    if len(found) == 1 and len(found[0]) <= 40:
                        words[found[0]] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    counted = texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where("word <> ''").orderBy(F.desc("n"), "word").limit(most).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))


def language_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b) from trigrams, bigrams and letters, interpolated."""
    c = counts.reshape(_A, _A, _A).astype(np.float64)
    one = c.sum(axis=(0, 1)) + 1
    two = c.sum(axis=0)
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (c + 5 * p2[None]) / (c.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


class Decoder:
    """Restores disguised words; results are kept for each process."""

    def __init__(self, counts: np.ndarray, config: Config, words: dict[str, int] | None = None) -> None:
        self.cost = language_costs(counts)
        self.config = config
        total = sum((words or {}).values()) + 1
        self.lexicon = {w: -math.log(n / total) for w, n in (words or {}).items() if len(w) <= config.word}
        self.single = {_RUN.sub(r"\1", w) for w in self.lexicon}
        self.known: dict[str, str] = {}
        self.joined: dict[str, str] = {}
        self._flat: list[float] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "joined": {}, "_flat": None}

    def _choices(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of the token: the strings that it may stand for, with the channel's cost; a space there is a word's end."""
        c = self.config
        for m in _RUN.finditer(token):
            run, sign = m[0], m[1]
            if sign == " ":
                yield [("", 0.0), (" ", c.ended)]
            elif sign in LOOKALIKES:
                letters = [(x * k, c.as_letter * len(run)) for x in LOOKALIKES[sign] for k in sorted({1, min(2, len(run)), len(run)})]
                own = [(run, 0.0)] if sign.isalpha() else []
                yield [*own, *letters, ("", c.dropped)] if letters else [("", c.set_apart), (" ", c.set_apart + c.ended)]
            elif sign.isalpha():
                own = [run[0]] * (len(run) > 1) + [run[:2]] * (len(run) > 2)
                yield [(run, 0.0), *[(x, c.shortened) for x in own]]
            else:
                yield [("", c.set_apart)]

    def restore(self, token: str) -> str:
        """The cheapest reading of a lower-case token; its words are set apart by a space."""
        if (found := self.known.get(token)) is not None:
            return found
        best = self._viterbi(token)
        if len(token) <= 64:
            if len(self.known) >= self.config.cache:
                self.known.clear()
            self.known[token] = best
        return best

    def _viterbi(self, token: str) -> str:
        if self._flat is None:
            self._flat = self.cost.ravel().tolist()
        flat, code, other = self._flat, _CODE, _A - 1
        # The last two characters' codes, and the cheapest path to them: its cost, and its pieces as a chain.
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for choices in self._choices(token):
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, chain) in states.items():
                for letters, extra in choices:
                    x, y, total = a, b, cost + extra
                    if letters == " ":
                        if y == 0:
                            continue
                        total += flat[(x * _A + y) * _A]
                        x, y = y, 0
                    else:
                        for ch in letters:
                            z = code.get(ch, other)
                            total += flat[(x * _A + y) * _A + z]
                            x, y = y, z
                    held = after.get((x, y))
                    if held is None or total < held[0]:
                        after[x, y] = total, (chain, letters) if letters else chain
            states = after
        chain = min((cost + (flat[(a * _A + b) * _A] if b else 0.0), k, chain) for k, ((a, b), (cost, chain)) in enumerate(states.items()))[2]
        pieces = []
        while chain:
            chain, letters = chain
            pieces.append(letters)
        return "".join(reversed(pieces)).strip(" ")

    def segmented(self, letters: str) -> list[str]:
        """The cheapest sequence of words that letters are: known ones by frequency, others by their letters."""
        if self._flat is None:
            self._flat = self.cost.ravel().tolist()
        flat, code, other, c = self._flat, _CODE, _A - 1, self.config
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * len(letters)
        for i in range(len(letters)):
            begun, a, b, spelled = best[i][0], 0, 0, 0.0
            for j in range(i + 1, min(i + c.word, len(letters)) + 1):
                z = code.get(letters[j - 1], other)
                spelled += flat[(a * _A + b) * _A + z]
                a, b = b, z
                cost = begun + min(self.lexicon.get(letters[i:j], math.inf), spelled + flat[(a * _A + b) * _A] + c.unknown)
                if cost < best[j][0]:
                    best[j] = cost, i
        out, j = [], len(letters)
        while j:
            out.append(letters[best[j][1] : j])
            j = best[j][1]
        return out[::-1]

    def _core(self, token: str) -> str | None:
        """What is left of a field that may hide a word, without what surrounds it."""
        while (cut := _OUTER.sub("", token)) != token:
            token = cut
        return token if len(token) >= 2 and _ODD.search(token) else None

    def words(self, token: str) -> list[str]:
        """The words of one lower-case field; of one that may hide a word, what it hides, as far as that is known."""
        if len(found := _WORD.findall(token)) == 1 and found[0] in self.lexicon:
            return found
        if core := self._core(token):
            # Without signs only repeated letters can be shortened: what then is no known word needs no decoding.
            if self.lexicon and not _SIGN.search(core) and _RUN.sub(r"\1", core) not in self.single:
                return []
            return [w for w in self.restore(core).split(" ") if not self.lexicon or w in self.lexicon]
        return found

    def runs(self, tokens: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first, end, restored) of runs of fields of one or two characters, repeated or not, which may be letters set apart."""
        short = [i for i, t in enumerate(tokens) if len(t) < 3 or (len(t) == 3 and t[2] in ".,;:!?") or (t[0] == t[-1] and t.count(t[0]) == len(t))]
        low = 0
        for k in range(1, len(short) + 1):
            if k == len(short) or short[k] != short[k - 1] + 1:
                if k - low >= self.config.run:
                    first, end = short[low], short[k - 1] + 1
                    fields = [f[:-1] if len(f) > 1 and f[-1] in ".,;:!?" else f for f in tokens[first:end]]
                    # At least three different characters, letters for the most part or look-alikes: neither figures in a row
                    # nor rules. And a row of short words that are known, of two letters all but one, is that.
                    own = {c for f in fields for c in f}
                    plain = sum(len(f) == 1 for f in fields) < 2 and all(f in self.lexicon for f in fields)
                    if not plain and len(own) > 2 and any(c.isalpha() for c in own):
                        yield first, end, self._run(" ".join(fields))
                low = k

    def _run(self, fields: str) -> str:
        if (found := self.joined.get(fields)) is None:
            found = self.restore(fields)
            if self.lexicon:
                found = " ".join(self.segmented(found.replace(" ", "")))
            if len(self.joined) >= self.config.cache:
                self.joined.clear()
            if len(fields) <= 64:
                self.joined[fields] = found
        return found

    def restored(self, text: str) -> str:
        """The text with its disguised fields restored in place; fields set apart letter by letter are joined."""
        fields = re.split(r"(\s+)", fold(text))
        words = [i for i in range(0, len(fields), 2) if fields[i]]
        joined = list(self.runs([fields[i].lower() for i in words]))
        for low, end, found in joined:
            for k in range(words[low], words[end - 1] + 1):
                fields[k] = ""
            fields[words[low]] = found
        inside = {words[k] for low, end, _ in joined for k in range(low, end)}
        for i in words:
            if i not in inside and (core := self._core(fields[i].lower())) and _WORD.search(core):
                at = fields[i].lower().find(core)
                if at >= 0 and len(fields[i].lower()) == len(fields[i]):
                    fields[i] = fields[i][:at] + self.restore(core) + fields[i][at + len(core) :]
        return "".join(fields)


# --- evidence ---

#: Parts of one that terms of the regression's sums are rounded to.
_UNIT = 1 << 32


def _outside(tokens: list[str], runs: list[tuple[int, int, str]]) -> set[str]:
    """The distinct fields that no run has."""
    if not runs:
        return set(tokens)
    inside = {k for low, end, _ in runs for k in range(low, end)}
    return {t for k, t in enumerate(tokens) if k not in inside}


class Features:
    """Bins of a field: of each of its words, the whole and its beginnings; kept for each process."""

    def __init__(self, decoder: Decoder) -> None:
        self.decoder, self.config = decoder, decoder.config
        self.known: dict[str, tuple[int, ...]] = {}

    def of_words(self, words: Iterable[str]) -> tuple[int, ...]:
        names = [n for w in words for n in (f"{w}$", *(w[:k] for k in self.config.beginnings if len(w) > k))]
        return tuple(zlib.crc32(n.encode()) % self.config.bins for n in names)

    def of(self, token: str) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            found = self.of_words(self.decoder.words(token))
            if len(self.known) >= self.config.cache:
                self.known.clear()
            self.known[token] = found
        return found

    def of_text(self, text: str) -> set[int]:
        tokens = fold(text).lower().split()
        joined = list(self.decoder.runs(tokens))
        return {i for t in _outside(tokens, joined) for i in self.of(t)}


def counts_by_class(labelled: DataFrame, decoder: Decoder, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that have each bin, and documents of each class; of rows (text, toxic)."""
    held = labelled.sparkSession.sparkContext.broadcast(decoder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value)
        total = np.zeros((2, config.bins + 1), np.int64)
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[toxic, list(features.of_text(text or ""))] += 1
                total[toxic, -1] += 1
        toxic, bins = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(total[toxic, bins])], names=["toxic", "bin", "n"])

    got = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, bin int, n bigint").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, config.bins + 1), np.int64)
    out[got.column("toxic").to_numpy(), got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return out[:, :-1], out[:, -1]


@dataclass
class Model:
    decoder: Decoder
    config: Config
    odds: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    fitted: bool = False

    def __post_init__(self) -> None:
        self._features: Features | None = None
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_features": None, "_known": {}}

    def _odds_of(self, bins: Iterable[int]) -> float:
        return max((float(self.odds[i]) for i in bins), default=0.0)

    def token_odds(self, token: str) -> float:
        """The strongest log odds among a field's bins."""
        found = self._known.get(token)
        if found is None:
            found = self._odds_of(self._features.of_words(self.decoder.words(token)))
            if len(self._known) >= self.config.cache:
                self._known.clear()
            self._known[token] = found
        return found

    def run_odds(self, found: str) -> list[float]:
        """Log odds of a restored run's words that are known, whole."""
        size, known = self.config.bins, self.decoder.lexicon
        return [float(self.odds[zlib.crc32(f"{w}$".encode()) % size]) for w in set(found.split(" ")) if len(w) > 3 and w in known]

    def evidence(self, text: str | None) -> list[float]:
        """1, the strongest field's log odds, the next three's, fields over 2, and their share."""
        self._features = self._features or Features(self.decoder)
        tokens = fold(text or "").lower().split()
        joined = list(self.decoder.runs(tokens))
        distinct = _outside(tokens, joined)
        known = self._known
        odds = [o if (o := known.get(t)) is not None else self.token_odds(t) for t in distinct]
        for *_, found in joined:
            odds += self.run_odds(found)
        top = sorted((o for o in odds if o > 0.5), reverse=True)
        strong = sum(o > 2 for o in top)
        return [1.0, top[0] if top else 0.0, sum(top[1:4]), min(strong, 10) / 3, 10 * strong / max(10, len(distinct))]

    def fit(self, rows: DataFrame, rounds: int = 60, ridge: float = 1e-2) -> Model:
        """Logistic regression of rows (x0, x1 and so on, toxic) by Newton steps, whose sums are over all rows."""
        w = np.zeros(len(self.weights))
        x = [F.col(f"x{k}") for k in range(len(w))]
        low, high = np.tril_indices(len(w))
        for _ in range(rounds):
            z = sum((x[k] * F.lit(float(w[k])) for k in range(len(w))), F.lit(0.0))
            given = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
            p = F.col("p")
            terms = [a * (p - F.col("toxic")) for a in x] + [x[i] * x[j] * p * (1 - p) for i, j in zip(low, high)]
            # Sums of whole numbers are the same in any order of rows.
            sums = [F.sum(F.rint(t * F.lit(float(_UNIT))).cast("bigint").cast("decimal(20,0)")) for t in terms]
            total = np.array([float(v or 0) / _UNIT for v in given.agg(*sums).first()])
            g = total[: len(w)] + ridge * w
            h = np.zeros((len(w), len(w)))
            h[low, high] = h[high, low] = total[len(w) :]
            step = np.linalg.solve(h + ridge * np.eye(len(w)), g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.fitted = w, True
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        x = np.array([self.evidence(t) for t in texts]).reshape(len(texts), len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", config: Config = Config()) -> Model:
    """A model learned from labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (_fold(F.col(id_col)) != HELD_OUT)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"), _fold(F.col(id_col)).alias("fold"))
    # Labels grow with the texts, so both are shuffled by id at any size; the rows found are written once, for both folds.
    text = docs.where(_fold(F.col(id_col)) != HELD_OUT).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = materialise(text.join(usable.hint("merge"), "id").select("text", "toxic", "fold"), "labelled")
    decoder = Decoder(corpus_trigrams(docs, text_col), config, frequent_words(labelled, config.words))
    by_class, n = counts_by_class(labelled.where(F.col("fold") != FOLDS - 1), decoder, config)
    s = config.smoothing
    rate = (by_class + s) / (n[:, None] + 2 * s)
    odds = np.log(rate[1] / rate[0])
    # A bin that few documents have proves little: its log odds shrink.
    seen = by_class.sum(axis=0)
    model = Model(decoder, config, (odds * seen / (seen + 3)).astype(np.float32))
    if not n.all():
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([held.value.evidence(t) for t in b.column(0).to_pylist()]).reshape(b.num_rows, 5)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(5)], b.column(1)], names=["x0", "x1", "x2", "x3", "x4", "toxic"])

    half = labelled.where(F.col("fold") == FOLDS - 1).select("text", "toxic").mapInArrow(run, "x0 double, x1 double, x2 double, x3 double, x4 double, toxic int")
    rows = materialise(half, "evidence")
    return model if rows.isEmpty() else model.fit(rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """(id, score, predicted), and restored texts if asked for."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                texts = part.column(1).to_pylist()
                s = held.value.scores(texts)
                columns = [part.column(0), pa.array(s), pa.array((s >= held.value.config.threshold).astype(np.int32))]
                if restored:
                    columns.append(pa.array([None if t is None else held.value.decoder.restored(t) for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "predicted", "restored"][: len(columns)])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, f"id {dict(ids.dtypes)['id']}, score double, predicted int" + ", restored string" * restored).withColumnRenamed("id", id_col)
