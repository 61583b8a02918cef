"""Each operator against a brute-force form, and on nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, licenses, pii, repetition, sharding, simhash, toxicity, warc

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", " \n\t", "a", "one two three", "one two three", "Über ß 漢字 😀 x", "word " * 60, LONG, "." * 50_000, "1" * 50_000]
#: Names that operators use inside.
CLASH = ["fp", "component", "id", "t", "w", "rid", "n_words", "spans", "items", "size", "shard", "part", "u", "h", "score", "first", "root", "a", "b", "n", "lang_pred", "start", "email"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def _fields(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None)], SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- repetition ---


def _brute_repetition(text, rules=repetition.Rules()):
    w = _fields(text)
    chars = sum(map(len, w))

    def covered(n):
        seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}

    earlier, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if _fields(line):
            if line in earlier:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, _fields(line)))
            earlier.add(line)
    repeat = len(covered(3))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    within = all(sum(len(w[k]) for k in covered(n)) / max(1, chars) <= most for n, most in rules.windows)
    kept = not failed and within and dup_chars / max(1, chars) <= 0.2
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, failed, kept


def test_repetition(spark, docs, empty):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "ç", "d#", "ee\n", "f|", "gg", "h", "i\ni", "漢"]) for _ in range(rng.randint(0, 140))) for _ in range(150)]
    # A passage that stands twice, within the base rule and yet rejected; and one that is short enough.
    own = [f"w{k}" for k in range(100)]
    texts += [" ".join([*own, "x", *own[20 : 20 + n]]) for n in (0, 4, 20, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in repetition.measure(df).collect()}
    assert [verdicts[150 + k] for k in range(4)] == [(False, True), (False, True), (False, False), (False, False)]
    for r in repetition.measure(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == _brute_repetition(texts[r.doc_id])
    found = repetition.measure(docs).collect()
    assert len(found) == len(TEXTS) + 2
    assert {r.doc_id: r.n_words for r in found}[8] == 60_000
    assert all(r.base_failed and not r.kept for r in found if not TEXTS[r.doc_id or 0])
    assert repetition.measure(empty).count() == 0


def test_repetition_of_texts_whose_polynomial_hashes_agree(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever its base."""
    for n in (1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        texts = [f"{word}\n{other}", f"{word} {other} x y z {word} {other}", " ".join(word), f"{word}\n{other}\n{word}\n{other}", " ".join(word) + "\n" + " ".join(other)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in repetition.measure(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == _brute_repetition(texts[r.doc_id]), (n, r.doc_id)


def test_earlier_tells_pieces_of_one_hash_apart():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 6, 40)
        first = repetition.earlier((x % 2).astype(np.uint64), lambda a, b: x[a] == x[b], lambda k: int(x[k]))
        assert first.tolist() == [x.tolist().index(v) for v in x.tolist()]


# --- personal data ---

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and _luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def _luhn(digits):
    return sum(d - 9 if (d := int(c) * (1 + i % 2)) > 9 else d for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii_base_spans(spark, docs, empty):
    rng = random.Random(2)
    bits = ["a@b.co", "1.2.3.4", "4111111111111111", "+1 234 567 8901", " ", "-", ".", "é", "7", "x", "@", "255.255.255.255", "4111-1111-1111-1111", "_", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["1.2.3.4 " * 3000, "a@" * 20_000, "+1 " * 20_000, "-1" * 30_000, "a@b.co_d@e.fr"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find(df, kinds=pii.BASE).collect():
        for kind, (pattern, ok) in PATTERNS.items():
            assert [(s.start, s.end) for s in r[kind]] == [(m.start(), m.end()) for m in re.finditer(pattern, texts[r.doc_id]) if ok(m[0])], (kind, texts[r.doc_id][:80])
    assert pii.find(docs).count() == len(TEXTS) + 2
    assert pii.find(empty).count() == 0


def test_pii_checksums_context_and_redaction(spark):
    text = "write a@b.co now, IBAN DE89370400440532013000 not DE88370400440532013000; 078-05-1120, ssn 078-05-1120. 4111 1111 1111 1111 +1 (499) 555-6503 password=e3b3ed3cc8548923d6 8.8.8.8!"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.find(df).collect()}
    assert len(r[1].iban) == 1 and len(r[1].ssn) == 1 and len(r[1].secret) == 1
    assert text[r[1].iban[0].start : r[1].iban[0].end] == "DE89370400440532013000"
    assert r[1].email[0].score > 0.8  # "write" stands before it
    out = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert out[1] == "write <EMAIL> now, IBAN <IBAN> not DE88370400440532013000; 078-05-1120, ssn <SSN>. <CARD> <PHONE> <SECRET> <IP>!" and out[2] is None


def test_pii_redacts_plain_cases(spark):
    cases = {
        "DE89 3704 0044 0532 0130 00 Please": "<IBAN> Please",
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF": "IBAN <IBAN> BIC COBADEFF",
        "PAY TO DE89370400440532013000 BY 12 MAY": "PAY TO <IBAN> BY 12 MAY",
        "AB12 3456 7890 1234 GB29 NWBK 6016 1331 9268 19 7": "AB12 3456 7890 1234 <IBAN> 7",
        "DE89370400440532013000X": "DE89370400440532013000X",
        'TOKEN = "9233A8C0FFEE9233" Password: hunter2hunter2 API_KEY=abcdef123456': '<SECRET>" <SECRET> <SECRET>',
        "SSN 123-45-6789, 987-65-4321": "SSN <SSN>, <SSN>",
        "078-05-1120, 987-65-4321": "078-05-1120, 987-65-4321",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert [(s.start, s.end) for s in found[6].ssn] == [(4, 15), (17, 28)]


def test_pii_of_the_query_equals_its_sql(spark, tmp_path):
    """Spans that need a country's length, a key in capitals, or context before another match; random IBAN-like texts against the SQL."""
    import duckdb

    from tidemark.llm import registry

    rng = random.Random(13)
    bits = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "XX11", "AB12 ", "NO9386011117947", "7", "Z", " ", " BIC COBADEFF", "é", "x", "FR14 2004 1010 0505 0001 3M02 606", "-", "ZZ68539007547034"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(800)]
    texts += ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "Password: abcdefgh12345678", "SSN 123-45-6789, 987-65-4321", "a hotel 078-05-1120", "social security 078-05-1120", "lessn 078-05-1120", None, "Visa 4111 1111 1111 1111"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in registry.QUERIES["op2_pii"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {r[0]: r for r in con.execute(registry.SQL["op2_pii"]).fetchall()}
    spans = {i: got[i][-1] for i in range(800, 808)}
    assert spans == {800: "iban:5:32", 801: "secret:0:26", 802: "ssn:4:15,ssn:17:28", 803: "", 804: "ssn:16:27", 805: "", 806: "", 807: "card:5:24"}
    assert sum("iban" in g[-1] for g in got.values()) > 100


# --- toxicity ---


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    plain, bad = ["the", "of", "thing", "other", "mountain", "river", "cloud", "stone", "walking"], ["idiot", "moron", "loser", "stupid"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(40)]
        if toxic:
            words[5:8] = [rng.choice(bad) for _ in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame([*rows, (9001, "the river 1d10t and m0r0n"), (9002, "of stone i d i o t s t u p i d"), (9003, None), (9004, ""), (9005, " ".join("the other cloud of total idiot river walking mountain stone".replace(" ", ""))), (9006, "the river iiddiioott and mmoorroonn"), (9007, "of " + "idiot-" * 12 + "x"), (9008, "x y z 1 2 3 a b c, the total 1990 of 5417 letters")], "doc_id long, text string")
    own = spark.createDataFrame([*labels, (9003, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, own)
    found = {r.doc_id: r for r in toxicity.score(df, model, restored=True).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].predicted == int(i % 3 == 0) for i in held)
    assert found[9001].predicted == 1 and found[9001].restored == "the river idiot and moron"
    assert found[9002].predicted == 1 and found[9003].predicted == 0 and found[9004].predicted == 0
    assert found[9005].predicted == found[9006].predicted == found[9007].predicted == 1 and found[9008].predicted == 0
    assert found[9005].restored.replace(" ", "") == "theothercloudoftotalidiotriverwalkingmountainstone" and "1990 of 5417" in found[9008].restored
    disguised = {i: rng.choice([lambda w: w.translate(str.maketrans("ioset", "1053+")), lambda w: "".join(c * 2 for c in w), " ".join, lambda w: w[0] + w[1:].replace(w[1], w[1] * 4)]) for i in held if i % 3 == 0}
    again = spark.createDataFrame([(i, " ".join(f(w) if w in bad else w for w in rows[i][1].split())) for i, f in disguised.items()], "doc_id long, text string")
    assert sum(r.predicted for r in toxicity.score(again, model).collect()) >= 0.95 * len(disguised) > 10
    assert all(0 <= r.score <= 1 for r in found.values())
    again = toxicity.score(df, toxicity.train(df, own.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))))
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in found.items()}  # held-out labels teach nothing
    none = toxicity.train(df, own.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.train(empty, own)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only labelled rows beyond the 30,000 of smallest hash have."""
    ids = spark.range(48_000).withColumnRenamed("id", "doc_id").withColumn("toxic", ((F.col("doc_id") % 10 == 0) | (F.col("doc_id") % 97 == 0)).cast("int"))
    word = F.when(F.col("doc_id") % 10 != 0, "walking").when(F.xxhash64("doc_id") > 6_500_000_000_000_000_000, "moron").otherwise("idiot")
    docs = ids.select("doc_id", F.concat_ws(" ", F.lit("the river"), word, F.element_at(F.array(*map(F.lit, ("stone", "cloud", "thing"))), (F.col("doc_id") % 3 + 1).cast("int"))).alias("text"))
    model = toxicity.train(docs, ids)
    assert (model.scores(["the moron stone", "the idiot cloud", "of m0r0n"]) >= 0.3).all() and model.scores(["the walking stone", None]).max() < 0.3


def test_regression_is_the_least_loss_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(900), rng.random((900, 4)) * [9, 20, 3, 10]])
    y = (x @ [-3, 0.5, 0.1, -0.4, 0.1] + rng.normal(size=900) > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "x0 double, x1 double, x2 double, x3 double, x4 double, toxic int")
    w = toxicity.Model(None, toxicity.Config(), np.zeros(1)).fit(rows).weights
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 1e-2 * w
    assert np.abs(slope).max() < 1e-4 and w.tolist() == toxicity.Model(None, toxicity.Config(), np.zeros(1)).fit(rows.orderBy("x1").repartition(5)).weights.tolist()


#: Ways to hide every word of a text.
DISGUISES = {
    "plain": lambda w: w,
    "spaced": " ".join,
    "doubled": lambda w: "".join(c * 2 for c in w),
    "dotted": ".".join,
    "leet": lambda w: w.translate(str.maketrans("ioeast", "10345+")),
    "pairs": lambda w: " ".join(w[k : k + 2] for k in range(0, len(w), 2)),
    "widthless": "\u200b".join,
    "full width": lambda w: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in w),
    "cyrillic": lambda w: w.translate(str.maketrans("aeopcxyij", "аеорсхуіј")),
}


def test_disguises_of_toxic_and_of_clean_texts(spark):
    """Clean texts stay clean whatever all their words are disguised as, toxic ones are caught; held-out rows of the driver's documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    held = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").where(toxicity._fold(F.col("doc_id")) == 2).select("text", "toxic").where("text IS NOT NULL").collect()
    clean = [" ".join(r.text.lower().split()[:30]) for r in held if not r.toxic][:300]
    toxic = [r.text.lower().split()[:400] for r in held if r.toxic]
    toxic = [w for w, s in zip(toxic, model.scores([" ".join(w) for w in toxic])) if s >= 0.3]
    assert len(clean) == 300 and len(toxic) > 60
    for name, f in DISGUISES.items():
        flagged = (model.scores([" ".join(map(f, t.split())) for t in clean]) >= 0.3).sum()
        caught = (model.scores([" ".join(map(f, w)) for w in toxic]) >= 0.3).sum()
        assert flagged <= 0.05 * len(clean) and caught >= 0.9 * len(toxic), (name, flagged, caught)
    spaced = " ".join("themeetingstartsatnineandthereportisdueonfridaypleasebringthenotes")
    assert model.scores([spaced])[0] < 0.3


def test_segmentation_is_the_cheapest_of_all():
    import itertools
    import math

    import pyarrow as pa

    words = {"the": 50, "idiot": 3, "of": 40, "stone": 5, "an": 9, "other": 6, "mother": 2, "he": 20, "to": 10}
    decoder = toxicity.Decoder(toxicity.trigram_counts(pa.array(["the idiot of the stone", "walking other mountains"] * 5)), toxicity.Config(), words)
    A, total = toxicity._A, sum(words.values()) + 1

    def cost(word):
        codes = [0, 0, *(toxicity._CODE[c] for c in word), 0]
        spelled = sum(float(decoder.cost.ravel()[(a * A + b) * A + c]) for a, b, c in zip(codes, codes[1:], codes[2:]))
        return min(spelled + decoder.config.unknown, -math.log(words[word] / total) if word in words else math.inf)

    for letters in ("theidiot", "ofthestone", "another", "tothemothe", "xqzthe", "a"):
        cuts = [[0, *c, len(letters)] for n in range(len(letters)) for c in itertools.combinations(range(1, len(letters)), n)]
        best = min(sum(cost(letters[a:b]) for a, b in itertools.pairwise(c)) for c in cuts)
        got = decoder.segmented(letters)
        assert "".join(got) == letters and abs(sum(map(cost, got)) - best) < 1e-4
    assert decoder.segmented("") == [] and decoder.segmented("theidiotofthestone") == ["the", "idiot", "of", "the", "stone"]


def test_viterbi_finds_the_cheapest_of_all_paths():
    import itertools

    import pyarrow as pa

    decoder = toxicity.Decoder(toxicity.trigram_counts(pa.array(["the idiot of the stone", "walking other mountains"] * 5)), toxicity.Config())
    A = toxicity._A

    def cost(pieces):
        a = b = 0
        total = 0.0
        for letters, extra in pieces:
            total += extra
            for ch in letters:
                if ch == " ":
                    if b == 0:
                        return float("inf")
                    z = 0
                else:
                    z = toxicity._CODE.get(ch, A - 1)
                total += float(decoder.cost[a, b, z])
                a, b = b, z
        return total + (float(decoder.cost[a, b, 0]) if b else 0.0)

    rng = random.Random(10)
    for _ in range(300):
        token = "".join(rng.choice("ththeiidot10@$3. -x漢") for _ in range(rng.randint(1, 7)))
        paths = [(cost(p), "".join(x for x, _ in p).strip(" ")) for p in itertools.product(*decoder._choices(token))]
        found = decoder.restore(token)
        assert abs(min(paths)[0] - min(c for c, t in paths if t == found)) < 1e-5
    assert len(decoder.restore("ab1@" * 30_000)) > 30_000 and decoder.restore(" ".join("idiot" * 5000)).replace(" ", "") == "idiot" * 5000


# --- byte-level BPE ---


def test_bpe(spark, docs, empty):
    import public_tokenizers as P

    vocabulary = bpe.Vocabulary(open(P.path(bpe.RANKS), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("  \n\n\t'''sstmdrevellRE aZé9५²!.,-  　漢字ñ😀\x1c\x85́") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "a" * 5000, "  " * 3000, "<|endoftext|>"]
    ids, offsets = vocabulary.encode(texts)
    data, firsts, _ = vocabulary.decode(ids, offsets)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode_ordinary(t)
        assert data[firsts[k] : firsts[k + 1]].tobytes() == t.encode()
    found = bpe.encode(docs.drop("n"), outputs=("token_ids", "token_starts", "decoded"))
    for r in bpe.decode(found, out_col="again").select("text", "token_ids", "token_starts", "decoded", "again").collect():
        text = (r.text or "").encode()
        assert bytes(r.decoded) == bytes(r.again) == text
        assert [text[a:b] for a, b in zip(r.token_starts, [*r.token_starts[1:], len(text)])] == [vocabulary.tokens[i] for i in r.token_ids]
    assert bpe.encode(empty).count() == 0


# --- language ---


def test_language(spark, docs, empty):
    rng = random.Random(5)
    own = {"xx": ["the", "thing", "of", "with", "wh"], "yy": ["und", "sch", "ein", "ver", "zü"]}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(60)), lang) for i in range(400) for lang in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame([*rows, (9001, None, "xx"), (9002, "12 34 --", "yy"), (9003, "the of the", None)], "doc_id long, text string, lang string")
    net = langid.train(df)
    found = {r.doc_id: r for r in langid.identify(df, net).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.98
    assert found[9001].lang_pred == found[9002].lang_pred == "und" and found[9003].lang_pred == "xx"
    kept = {r.doc_id for r in langid.keep_identified(df, net).collect()}
    assert kept >= set(range(400)) and not kept & {9001, 9002}
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert langid.identify(docs, net).count() == len(TEXTS) + 2
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_language_of_few_labels_among_many_rows(spark):
    rng = random.Random(8)
    own = {"xx": ["the", "thing", "of", "with", "wh"], "yy": ["und", "sch", "ein", "ver", "zü"]}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(60)), lang) for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    blank = spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit("12 --").alias("text"), F.lit("zz").alias("lang"))
    rest = spark.range(2000, 300_000).select(F.col("id").alias("doc_id"), F.lit("any").alias("text"), F.lit(None).cast("string").alias("lang"))
    config = langid.Config(train_rows=100, epochs=40)
    net = langid.train(labelled.union(blank).union(rest), config=config)
    alone = langid.train(labelled, config=config)
    assert net is not None and net.langs == ["xx", "yy"]
    assert all((net.p[k] == alone.p[k]).all() for k in net.p)  # other rows take no place among the training rows
    assert langid.keep_identified(labelled, net).count() == len(rows)


def test_language_network(spark):
    """Folded inference equals a direct convolution, gradients equal differences, and numerals are no letters."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    config = langid.Config(window=12, widths=(2, 3), filters=3, embedding=2)
    net = langid.Network(config, ["aa", "bb", "cc"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net._fold()
    x, y = rng.integers(97, 104, (7, 12)).astype(np.uint8), rng.integers(0, 3, 7)
    direct = []
    for row in x:
        emb, pooled = net.p["emb"][row], []
        for w in config.widths:
            z = np.array([emb[i : i + w].ravel() @ net.p[f"w{w}"] + net.p[f"b{w}"] for i in range(12 - w + 1)])
            pooled.append(np.maximum(z.max(axis=0), 0))
        z = np.concatenate(pooled) @ net.p["out"] + net.p["bias"]
        direct.append(np.exp(z) / np.exp(z).sum())
    assert np.allclose(net.probabilities(x), direct)
    g, _ = net.gradients(x, y)
    for name, at in (("out", (1, 2)), ("bias", (0,)), ("w2", (1, 0)), ("b3", (2,)), ("emb", (int(x[0, 3]), 1))):
        losses = []
        for step in (1e-5, -1e-5):
            net.p[name][at] += step
            losses.append(net.gradients(x, y)[1])
            net.p[name][at] -= step
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-4
    assert net.predict(pa.array(["² ½ ①", None, "12", "ñ", "ª"]))[0][:3] == ["und"] * 3
    assert all(p != "und" for p in net.predict(pa.array(["ñ", "x²"]))[0])


# --- licences ---


def test_licenses(spark, docs, empty):
    texts = ["x cc-by y. CC BY! Released under the MIT License. z", "This is the GNU  General Public\nLicense, version 3, all rights reserved", "general public", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", None, "a all rights reserved " * 3000, "mit license"]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = _words(t)
        places = sorted((label, k) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert found[i].n_words == len(w) and sorted((p.label, p.start) for p in found[i].places) == places
    assert {f.label for f in found[0].found} == {"mit"} and found[0].found[0].start == 6
    assert {f.label for f in found[3].found} == {"mit"} and "gpl" in {p.label for p in found[1].places}
    assert not found[6].found  # its key phrase stands, but little else of the notice
    assert licenses.scan(docs).count() == len(TEXTS) + 2
    assert licenses.scan(empty).count() == 0


# --- decontamination ---


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    vocabulary = ["the", "of", "Ü", "x1", "zz", "Q"]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([12, 3, 10, 11, 1])] + [("i2", "of the"), ("e", ""), ("n", None)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [items[0][1] + ", tail", "head " + items[2][1].lower(), None, ""]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = _words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for blocks in ({}, {"block_windows": 12}):
        for r in decontam.contamination(df, bench, **blocks).collect():
            w, hit, own = _words(texts[r.doc_id]), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        own |= found
            assert {k for s in r.spans for k in range(s.first, s.end)} == hit and set(r.items) == own and r.n_words == len(w)
    one = spark.createDataFrame([items[0]], "item_id string, text string")
    kept = {r.doc_id for r in decontam.decontaminate(df, one).collect()}
    assert 80 not in kept and 83 in kept and 82 in kept
    cut = {r.doc_id: r.text for r in decontam.decontaminate(df, one, remove="span").collect()}
    assert cut[80] == ", tail" and len(cut) == len(texts)
    assert decontam.contamination(docs, bench).count() == len(TEXTS) + 2
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_decontamination_of_repeated_and_null_ids_in_blocks(spark):
    items = [("i0", " ".join(f"a{k}" for k in range(12))), ("i1", " ".join(f"b{k}" for k in range(12)))]
    texts = [(1, items[0][1]), (1, "x " + items[1][1]), (1, "clean"), (None, items[1][1]), (None, "c d"), (1, items[0][1]), (2, f"{items[0][1]} {items[1][1]}")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda **k: sorted(map(str, decontam.contamination(df, bench, **k).collect()))
    assert len(rows()) == len(texts) and rows(block_windows=5) == rows()


# --- near-duplicates ---


def _brute_fingerprint(text):
    w = _fields(_lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def _brute_components(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 3}, {"blocks": 4}, {"blocks": 6}])
def test_simhash(spark, options):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))] for _ in range(12)]
    texts = []
    for w in base:
        for _ in range(rng.randint(1, 12)):
            x = list(w)
            for _ in range(rng.randint(0, 2)):
                if x:
                    x[rng.randrange(len(x))] = "CHANGED"
            texts.append(" ".join(x))
    texts += [None, "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(df, **options).collect()}
    prints = {i: _brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in found.items()} == prints
    assert {i: c for i, (_, c) in found.items()} == _brute_components(prints)


def test_simhash_chain_and_edges(spark, docs, empty):
    chain = [(i, (1 << i) - 1) for i in range(0, 62, 3)]
    edges = spark.createDataFrame([(a[1], b[1]) for a, b in zip(chain, chain[1:])], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(4) == 1 and 5 not in ids and None in ids and 0 in ids and 1 not in ids
    assert simhash.near_duplicates(docs).count() == len(TEXTS) + 2
    assert simhash.near_duplicates(empty).count() == 0


def _brute_similar(texts: dict, least: float = 0.8) -> dict:
    """The smallest id that each text reaches over pairs of at least `least` by their sets of five words."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if (x == y or len(x & y) >= least * len(x | y)) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 40}])
def test_keep_one_by_similarity(spark, options):
    """A group of copies above the size of pairwise comparison, pairs on both sides of 0.8, chains, empty and short texts."""
    rng = random.Random(11)

    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    texts = []
    hot = text(400)
    for _ in range(150):
        x = list(hot)
        x[rng.randrange(400)] = f"n{rng.randrange(10**6)}"
        texts.append(x)
    for _ in range(40):
        x = text(300)
        texts.append(x)
        for _ in range(2):
            x = list(x)
            for k in rng.sample(range(300), rng.choice([1, 3, 6, 20, 60])):
                x[k] = "CHANGED"
            texts.append(x)
    texts = [" ".join(x) for x in texts] + [None, "", "ab", "AB", "a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = _brute_similar(dict(enumerate(texts)))
    kept = {r.doc_id for r in simhash.keep_one(df, **options).collect()}
    # Blocks are sampled, so a pair near 0.8 may share none: nothing goes that should stay, and most that should go goes.
    assert kept >= set(want.values())
    goes, wanted = len(texts) - len(kept), len(texts) - len(set(want.values()))
    assert goes >= 0.95 * wanted, (goes, wanted)


def test_forest_connects_what_pairs_connect():
    """Against all pairs: links connect what pairs within the distance connect, sure ones what certain pairs connect, in small and large groups alike."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)
    fp = base[rng.integers(0, 40, 400)]
    for _ in range(3):
        fp[:, 0] ^= np.uint64(1) << rng.integers(0, 40, 400).astype(np.uint64)
    group = np.sort(rng.choice([1, 1, 1, 2, 3, 4], 400))

    def joined(pairs):
        parent = list(range(400))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            parent[max(root(x), root(y))] = min(root(x), root(y))
        return [root(x) for x in range(400)]

    every = [(i, j, int(simhash._bits(fp[i], fp[j]))) for i in range(400) for j in range(i) if group[i] == group[j]]
    for small in (0, 1, 64, 400):
        a, b, sure = simhash._forest(fp, group, 2, 4, small)
        assert (group[a] == group[b]).all() and len(a) < 400
        assert joined(zip(a.tolist(), b.tolist())) == joined([(i, j) for i, j, d in every if d <= 4])
        assert joined(zip(a[sure].tolist(), b[sure].tolist())) == joined([(i, j) for i, j, d in every if d <= 2])
    assert all(len(x) == 0 for x in simhash._forest(fp[:0], group[:0], 2, 4))


def test_blocks_follow_the_number_of_texts():
    assert simhash.blocks_for(10) == simhash.blocks_for(200_000) == (66, 18)
    keys, bits = simhash.blocks_for(10**9)
    assert bits == 30 and 400 < keys < 500


@pytest.mark.parametrize("key_bits", [18, 3])
def test_keep_one_of_a_large_family(spark, key_bits):
    """600 texts of one family, most pairs of which lie below 0.8, and 80 true copies: how large blocks are changes nothing."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for k in range(600):
        x = list(base)
        for at in rng.sample(range(200), 5):
            x[at] = f"n{k}.{at}"
        texts.append(x)
    for k in range(80):
        x = list(texts[rng.randrange(600)])
        x[199 - k % 3] = f"z{k}"
        texts.append(x)
    texts = [" ".join(x) for x in texts]
    want = _brute_similar(dict(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(df, key_bits=key_bits, keys=64 if key_bits > 6 else 16, chunk_rows=200).collect()}
    assert kept == {i for i, c in want.items() if i == c} and 550 < len(kept) <= 600


def test_keep_one_of_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, one), (None, three), (None, three), (None, two), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert kept == {(1, one): 1, (1, two): 1, (None, three): 1, (3, None): 1}


# --- sharding ---


def _least_capacity(sizes, shards):
    def feasible(c):
        n, now = 1, 0
        for s in sizes:
            if s > c:
                return False
            if now + s > c:
                n, now = n + 1, 0
            now += s
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if feasible(m) else (m + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_sharding_capacity(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-(2**63), 2**63) if rng.random() < 0.7 else rng.randrange(50), rng.choice([1, 5, 1000, 16])) for _ in range(rng.choice([1, 3, 30, 300]))]
    shards = rng.choice([1, 2, 5, 40])
    groups = collections.Counter()
    for h, s in rows:
        groups[h] += s
    cuts, capacity = sharding.cut_hashes(spark.createDataFrame(rows, "h long, size long"), shards, resolution=64, first_bits=3)
    load = collections.Counter()
    for h, s in rows:
        load[sum(h >= c for c in cuts)] += s
    assert capacity == _least_capacity([groups[h] for h in sorted(groups)], shards) and max(load.values()) <= capacity and len(cuts) < shards


def test_sharding_of_many_groups(spark):
    """Thousands of distinct texts between large groups of copies: many ranges to split that aren't neighbours."""
    rng = random.Random(9)
    own = [(rng.randrange(-(2**63), 2**63), rng.randint(20, 3000)) for _ in range(6000)]
    copies = [(rng.randrange(-(2**63), 2**63), 500) for _ in range(60)]
    rows = own + [c for c in copies for _ in range(rng.choice([2, 40, 700]))]
    groups = collections.Counter()
    for h, s in rows:
        groups[h] += s
    for resolution in (1 << 17, 1 << 10):
        cuts, capacity = sharding.cut_hashes(spark.createDataFrame(rows, "h long, size long"), 40, resolution=resolution, first_bits=9)
        load = collections.Counter()
        for h, s in rows:
            load[sum(h >= c for c in cuts)] += s
        assert capacity == _least_capacity([groups[h] for h in sorted(groups)], 40) and max(load.values()) <= capacity and len(cuts) < 40


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("shard"), f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == docs.count() and back.select("text", "shard").distinct().groupBy("text").count().where("count > 1").isEmpty()


def test_sharding_rows(spark, docs, empty):
    found = sharding.assign(docs, shards=4, slot_rows=2).collect()
    by_shard, by_text = collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        by_shard[r.shard].append(r.slot)
        by_text[r.text_crc32, r["size"]].add(r.shard)
        if r.doc_id is not None:
            text = (TEXTS[r.doc_id] or "").encode()
            assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
    assert len(found) == len(TEXTS) + 2 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.assign(empty).count() == 0


# --- archives ---


def test_warc(spark):
    big, bigger = "x\r\n\r\nWARC/1.0 " * 100, "é" * 700
    rows = [(1, "http://a/ b", big), (2, "http://a", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "http://é/\n", bigger), (9, "v", bigger), (9, "v", bigger), (None, "w", bigger), (7, "f", "filedesc://x 0 0 0 1\n" * 80), (8, "y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("payload", F.lit("clash"))
    found = warc.archive_pages(pages.repartition(3)).collect()
    assert len(found) == len(rows)
    payload = {i: (h or "").encode() for i, _, h in rows}
    top = {1: 2, 2: 2, 6: 9, None: 9, 9: 9}
    for r in found:
        own = payload[r.page_id]
        assert r.payload_bytes == len(own) and r.payload_digest == hashlib.sha1(own).hexdigest()
        revisit = r.page_id in top and top[r.page_id] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", top[r.page_id]) if revisit else ("response", None))
    assert warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 3_000])
def test_warc_urls_ids_and_archives(spark, tmp_path, archive_bytes):
    """URLs come back in ASCII, identifiers are unique and referred to, archives are bounded and begin with a warcinfo."""
    import gzip
    import io
    import urllib.parse

    long = "long\nline " * 400_000
    rows = [(i, f"http://x.org/é/漢 {i % 3}\t😀", "same payload " * 100) for i in range(12)] + [(3, "http://x.org/plain?a=%20", "p")] * 3 + [(99, "http://l", long), (100, None, "é" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    arc, out = f"{tmp_path}/arc", f"{tmp_path}/warc"
    warc.write_arc(pages, arc, archive_bytes=archive_bytes)
    warc.convert(spark, arc, out, archive_bytes=archive_bytes)
    got = warc.warc_records(spark, out, payloads=True).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    want = sorted((str(i), urllib.parse.quote(u, safe=":/?=&%") if u else f"urn:page:{i}") for i, u, _ in rows)
    assert sorted((r.key, r.url) for r in got) == want and all(urllib.parse.unquote(r.url) == dict((str(i), u) for i, u, _ in rows[:12]).get(r.key) for r in got if r.payload_bytes == 1300 and r.key != "3")
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    revisits = [r for r in got if r.record_type == "revisit"]
    assert len(revisits) == 11 and all(responses[r.refers_to].key == "11" for r in revisits)
    assert next(r for r in got if r.key == "99").payload == long.encode()
    files = list((tmp_path / "warc").glob("*.gz"))
    assert (len(files) > 4) == (archive_bytes == 3_000)
    for f in files:
        records = list(warc.read_warc(io.BytesIO(gzip.decompress(f.read_bytes()))))
        assert records[0][0]["warc-type"] == "warcinfo" and all(r[0]["warc-type"] != "warcinfo" for r in records[1:])
        assert sum(len(b) for _, b in records[1:-1]) <= archive_bytes


def test_arc_versions_and_lengths():
    import io

    for version in (1, 2):
        text = warc.arc_version_block(version) + warc.arc_record(version, "7", "http://h", "pay\n\nload") + "\n" + warc.arc_record(version, "8", None, "") + "\n"
        got = list(warc.read_arc(io.BytesIO(text.encode())))
        assert [g["url"] for g in got] == ["http://h", "urn:page:8"] and warc._head(got[0]["block"])[1] == b"pay\n\nload"
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(text.encode()[:-20])))
    assert warc.timestamp("19961231235958") == "1996-12-31T23:59:58Z" and warc.timestamp("1997") == "1997-01-01T00:00:00Z" and warc.timestamp("-") == "1970-01-01T00:00:00Z"


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, sf)
        if name != "encoding":
            assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
            got.write.parquet(f"{tmp_path}/{name}")
            got = spark.read.parquet(f"{tmp_path}/{name}")
    rows = got.collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = _words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    hit = {i for i, t in texts.items() if any(tuple(_words(t)[k : k + 10]) in windows for k in range(len(_words(t)) - 9))}
    component = _brute_similar(texts)
    assert {r.doc_id for r in rows} == {i for i in texts if component[i] == i and i not in hit}


def test_pipeline_stages_on_edge_cases(spark, docs, empty):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables in every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = docs.drop("n", "id", "text_crc32").withColumn("__clash", F.lit("x"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        got = stage(spark, odd, sf)
        kept[name] = got.count()
        if name != "encoding":
            assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes), name
    assert kept["personal_data"] == kept["decontamination"] == kept["encoding"] == len(TEXTS) + 2
    assert 0 < kept["near_dedup"] < len(TEXTS) + 2
    without = corpus_pipeline.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), sf)
    assert without.count() == 0
