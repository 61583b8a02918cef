"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, licenses, mixing, pii, repair, repetition, runs, sharding, simhash, toxicity, warc
from tidemark.llm.common import held_out, table


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents"))


def _op1_sql(rules: repetition.Rules = repetition.Rules()) -> str:
    """Windows by their whole texts instead of hashes; a word is covered if one of the last windows begun is repeated."""
    lengths = sorted({rules.repeat_window, *(k for k, _ in rules.windows)})
    text = lambda k: " || ' ' || ".join(["t", *(f"lead(t, {j}) OVER w" for j in range(1, k))])
    parts = ", ".join(
        f"""w{k} AS (SELECT rid, i, len(t) AS chars, CAST(g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS INT) AS again FROM (SELECT *, {text(k)} AS g FROM tok WINDOW w AS (PARTITION BY rid ORDER BY i))),
c{k} AS (SELECT rid, count(*) AS n, sum(chars) AS chars FROM (SELECT *, max(again) OVER (PARTITION BY rid ORDER BY i ROWS {k - 1} PRECEDING) AS hit FROM w{k}) WHERE hit = 1 GROUP BY rid)"""
        for k in lengths
    )
    joins = " ".join(f"LEFT JOIN c{k} USING (rid)" for k in lengths)
    shares = ", ".join(f"coalesce(c{k}.chars, 0) / greatest(word_chars, 1) AS share_{k}" for k, _ in rules.windows)
    named = ", ".join(f"CAST(share_{k} AS DOUBLE) AS share_{k}" for k, _ in rules.windows)
    within = " AND ".join(f"share_{k} <= {most}" for k, most in rules.windows)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS k FROM d, unnest(string_split(text, chr(10))) AS g(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
tok AS (SELECT rid, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
dup AS (SELECT rid, count(*) AS n, sum(len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE k > 1 GROUP BY rid),
{parts},
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(c{rules.repeat_window}.n, 0) AS n_repeat_words, {shares}, coalesce(dup.chars, 0) / greatest(word_chars, 1) AS line_share
  FROM d LEFT JOIN dup USING (rid) {joins}),
f AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  {named}, CAST(line_share AS DOUBLE) AS line_share, base_failed, NOT base_failed AND {within} AND line_share <= {rules.most_line_share} AS kept FROM f
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.BASE]
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(pii.listed(F.concat(*base)).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat(*[k.name for k in pii.KINDS])).alias("spans"),
    )


def _op2_sql() -> str:
    """The plain patterns; places are sums of the lengths before them."""
    digits = "regexp_replace({0}, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN k % 2 = 0 THEN CASE WHEN 2 * CAST(dg[-k] AS INT) > 9 THEN 2 * CAST(dg[-k] AS INT) - 9 ELSE 2 * CAST(dg[-k] AS INT) END ELSE CAST(dg[-k] AS INT) END FOR k IN range(1, len(dg) + 1)]) % 10 = 0"
    turned = "replace(m, ' ', '')"
    mod97 = f"list_reduce(list_concat([0], [CASE WHEN unicode(c) < 65 THEN unicode(c) - 48 ELSE unicode(c) - 55 END FOR c IN string_split(substr({turned}, 5) || substr({turned}, 1, 4), '')]), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
    octet = pii._OCTET
    valid = {
        "email": "true",
        "ip": f"regexp_full_match(m, '{octet}(?:[.]{octet}){{3}}')",
        "card": f"len(dg) BETWEEN 13 AND 19 AND {luhn}",
        "phone": "len(dg) BETWEEN 9 AND 15",
        "iban": f"NOT regexp_matches(substr(text, s + len(m) + 1, 1), '[A-Za-z0-9]') AND {mod97}",
        "secret": "regexp_matches(m, '[0-9]')",
        "ssn": "NOT regexp_matches(right(b, 1), '[0-9-]') AND NOT regexp_matches(left(a, 1), '[0-9-]')",
    }
    known = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?:[^A-Za-z0-9]|$)" for n, c in pii._IBAN_REST.items())
    parts, ctes = [], []
    for n, kind in enumerate(pii.KINDS):
        plain = "[A-Z]{2}[0-9]{2}" if kind.name == "iban" else kind.plain
        near = f"regexp_matches(lower(right(left(text, s), {pii.CONTEXT})), '{kind.context}')"
        enough = "true" if kind.prior >= pii.LEAST_SCORE else near
        ctes.append(f"""x{n} AS (SELECT rid, text, regexp_extract_all(text, '{plain}') AS ms, string_split_regex(text, '{plain.replace("(", "(?:").replace("(?:?i:", "(?i:")}') AS bs FROM d WHERE regexp_matches(text, '{plain}')),
y{n} AS (SELECT rid, text, i, ms[i] AS m, bs[i] AS b, bs[i + 1] AS a, string_split({digits.format("ms[i]")}, '') AS dg, CAST(list_sum(list_transform(bs[:i], lambda s: len(s))) + coalesce(list_sum(list_transform(ms[: i - 1], lambda s: len(s))), 0) AS BIGINT) AS s FROM x{n}, unnest(range(1, len(ms) + 1)) AS g(i))""")
        source = f"y{n}"
        if kind.name == "iban":
            # Where one may begin, how far it goes, and of those the leftmost that don't overlap.
            source = "ib"
            ctes.append(f"""ib1 AS (SELECT rid, text, s, substr(text, s + 1, 90) AS t FROM y{n} WHERE NOT regexp_matches(right(left(text, s), 1), '[A-Za-z0-9]')),
ib2 AS (SELECT rid, text, s, CASE WHEN regexp_matches(t, '^(?:{known})') THEN regexp_replace(regexp_extract(t, '^(?:{known})'), '[^A-Za-z0-9]$', '') ELSE regexp_extract(string_split_regex(t, ' [A-Z]{{2}}[0-9]{{2}}')[1], '^{pii._OPEN}') END AS m FROM ib1),
ib3 AS (SELECT *, s + len(m) AS e FROM ib2 WHERE m <> ''),
ib4 AS (SELECT *, (SELECT min(o.s) FROM ib3 o WHERE o.rid = c.rid AND o.s >= c.e) AS nx, s = min(s) OVER (PARTITION BY rid) AS head FROM ib3 c),
ib AS (SELECT rid, text, m, s, nx FROM ib4 WHERE head UNION ALL SELECT n.rid, n.text, n.m, n.s, n.nx FROM ib JOIN ib4 n ON n.rid = ib.rid AND n.s = ib.nx)""")
        parts.append(f"SELECT rid, {n} AS k, '{kind.name}' AS kind, s, CAST(s + len(m) AS BIGINT) AS e FROM {source} WHERE ({valid[kind.name]}) AND {enough}")
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{k.name}" for n, k in enumerate(pii.BASE))
    lists = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(ctes)},
s AS ({" UNION ALL ".join(parts)}),
t AS (SELECT rid, {counts}, {lists} FILTER (k < {len(pii.BASE)}) AS base, {lists} AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (rid)
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=("token_ids", "decoded"))
    return found.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), bpe.ids_sha256().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.joined(base).alias("base_labels"),
        licenses.joined(F.concat(base, F.transform("found", lambda p: p["label"]))).alias("labels"),
        licenses.scores(F.col("places"), F.col("found")).alias("score"),
    )


def _op6_sql(config: licenses.Config = licenses.Config()) -> str:
    """Document frequencies, the rarest words of each notice, and sums of what aligns, without an index or a gate."""
    quoted = ", ".join(f"({k}, '{n.label}', '{n.text}', [{', '.join(repr(x) for x in n.keys)}])" for k, n in enumerate(licenses.NOTICES))
    fixed = ", ".join(f"({k}, '{v}', '{p}')" for k, (p, v) in enumerate(licenses.PHRASES.items()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT rid, w[i] AS w, i - 1 AS pos FROM d, unnest(range(1, len(w) + 1)) AS g(i)),
n(e, label, text, keys) AS (VALUES {quoted}),
nw AS (SELECT e, string_split(text, ' ')[i] AS w, i - 1 AS p FROM n, unnest(range(1, len(string_split(text, ' ')) + 1)) AS g(i)),
must AS (SELECT DISTINCT e, p + j AS p FROM (SELECT n.e, nw.p, len(string_split(k, ' ')) AS size FROM n, unnest(keys) AS u(k), nw WHERE nw.e = n.e AND array_to_string(string_split(text, ' ')[nw.p + 1 : nw.p + len(string_split(k, ' '))], ' ') = k), unnest(range(size)) AS g(j)),
df AS (SELECT w, count(DISTINCT rid) AS n FROM tok GROUP BY w),
ranked AS (SELECT e, w, round(ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))), 6) AS idf, row_number() OVER (PARTITION BY e ORDER BY coalesce(n, 0), w) AS k FROM (SELECT DISTINCT e, w FROM nw) LEFT JOIN df USING (w)),
post AS (SELECT nw.e, nw.w, nw.p, coalesce(idf, 0) / coalesce(nullif(sum(coalesce(idf, 0)) OVER (PARTITION BY nw.e), 0), 1) AS weight, CAST(must.p IS NOT NULL AS INT) AS must FROM nw LEFT JOIN ranked r ON r.e = nw.e AND r.w = nw.w AND r.k <= {config.rare} LEFT JOIN must ON must.e = nw.e AND must.p = nw.p),
need AS (SELECT e, sum(must) AS need FROM post GROUP BY e),
found AS (SELECT * FROM (SELECT rid, e, pos - p AS start, round(sum(weight), 6) AS score, sum(must) AS got FROM tok JOIN post USING (w) WHERE must = 1 OR weight > 0 GROUP BY ALL) JOIN need USING (e) WHERE got = need AND score >= {config.least_score}),
ph(e, label, text) AS (VALUES {fixed}),
places AS (SELECT rid, label, pos AS start FROM tok JOIN d USING (rid), ph WHERE array_to_string(d.w[pos + 1 : pos + len(string_split(text, ' '))], ' ') = text AND tok.w = string_split(text, ' ')[1]),
pa AS (SELECT rid, count(*) AS n, min(start) AS a, max(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION ALL SELECT rid, label FROM found JOIN n USING (e)) GROUP BY rid),
sc AS (SELECT rid, max(least(1.0, score)) AS score FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pa.n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(pa.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CAST(greatest(coalesce(sc.score, 0), CASE WHEN pa.n > 0 THEN {licenses.PHRASE_SCORE} ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN pa USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: Words, then every place where an item's window stands (by its first word and its whole text), then the union of their words.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS g(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM d, lens, unnest(generate_series(1, len(w) - n + 1)) AS g(i) WHERE len(w) >= n),
hits AS (SELECT rid, i, dw.n, item FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS g(k) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), repeat_tails=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: Shares by filling up in the order of size over weight; what a document gives by its place in its source's stream.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(sum(w) OVER r AS BIGINT) AS rest, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - CAST(coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS share
  FROM s WINDOW r AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * rest <= w * share AS capped FROM o),
f AS (SELECT coalesce(max(share) FILTER (NOT capped AND rest = top), 0) AS share, coalesce(max(top), 1) AS weight FROM c, (SELECT max(rest) FILTER (NOT capped) AS top FROM c)),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE w * f.share / f.weight END AS target, CASE WHEN capped THEN 3 * source_size ELSE w * f.share // f.weight END AS words FROM c, f),
p AS (SELECT d.doc_id, size, source_size, target, words, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size) + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken FROM p
"""


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summary(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition": op1_repetition,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_mixing": op12_mixing,
    "op13_conversations": op13_conversations,
}

SQL: dict[str, str] = {
    "op1_repetition": _op1_sql(),
    "op2_pii": _op2_sql(),
    "op6_licenses": _op6_sql(),
    "op7_decontamination": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op12_mixing": OP12_SQL,
}
