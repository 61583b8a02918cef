"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is DataFrame functions. A text that a cheap test clears of a kind is not searched for it. Otherwise the
pattern cuts the text into matches and what stands between them; running sums of their lengths (in blocks, so that
many matches in one text stay cheap) are the matches' places, and the text before a match is its context.

Patterns are written so that Java's matcher runs in linear time (possessive loops, no start inside a run); each is
the plain pattern beside it in meaning.

Defined results: null is the empty text; repeated rows give repeated results; spans are in code points, end
exclusive, leftmost and non-overlapping for each kind, and may overlap between kinds; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches in a block of the running sums.
_BLOCK = 256
#: Code points before a match in which a context word counts.
CONTEXT = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1."""
    turned = F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _outside(before: Column, after: Column, chars: str) -> Column:
    """Neither neighbour of a match is one of the characters."""
    return ~F.right(before, F.lit(1)).rlike(f"[{chars}]") & ~F.left(after, F.lit(1)).rlike(f"[{chars}]")


@dataclass(frozen=True)
class Kind:
    """plain: the pattern's meaning; java: the same for Java's matcher; gate: a cheap test that no text with a match fails.

    valid takes a match, the text before it (back to the last match) and after it (up to the next). prior is the
    score of a valid match, boost what a context word adds; a span stays if its score reaches LEAST_SCORE. The context
    ends at the last match, or (far) goes on before it.
    """

    name: str
    plain: str
    java: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column, Column, Column], Column]
    context: str
    prior: float
    boost: float
    far: bool = False


LEAST_SCORE = 0.5
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_KEYS = ("password", "token", "secret", "api_key")
BASE = (
    Kind(
        "email",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m, b, a: F.lit(True),
        "mail|contact|write",
        0.8,
        0.15,
    ),
    Kind(
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        lambda m, b, a: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "ip|address|host|server",
        0.6,
        0.3,
    ),
    Kind(
        "card",
        r"[0-9]([ -]?[0-9])+",
        r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        lambda m, b, a: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)),
        "card|visa|credit|pay",
        0.7,
        0.25,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda m, b, a: F.length(_digits(m)).between(9, 15),
        "tel|phone|call|mobil|fax",
        0.6,
        0.3,
    ),
)
ADDED = (
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
        lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
        lambda m, b, a: _outside(b, a, "A-Za-z0-9") & mod97(F.regexp_replace(m, " ", "")),
        "iban|account|bank|konto|cuenta|compte",
        0.8,
        0.15,
    ),
    Kind(
        "secret",
        f"({'|'.join(_KEYS)}) ?[=:] ?\"?[0-9A-Za-z_-]{{12,}}",
        f"(?:{'|'.join(_KEYS)}) ?[=:] ?\"?[0-9A-Za-z_-]{{12,}}",
        lambda t: t.contains(_KEYS[0]) | t.contains(_KEYS[1]) | t.contains(_KEYS[2]) | t.contains(_KEYS[3]),
        lambda m, b, a: m.rlike("[0-9]"),
        "login|user|auth|key",
        0.7,
        0.2,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m, b, a: _outside(b, a, "0-9-"),
        "ssn|social security",
        0.3,
        0.6,
    ),
)
#: Characters of an IBAN after its country and check digits.
_IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG",
    21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])" for n, c in _IBAN_REST.items())
#: An IBAN of no known length, short of what may begin another.
_OPEN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
#: By its country's length, else as long as capitals and digits go on, short of what may begin another.
_IBAN = rf"(?<![A-Za-z0-9])(?:{_KNOWN}|[A-Z]{{2}}[0-9]{{2}}(?:(?: (?![A-Z]{{2}}[0-9]{{2}}))?[A-Z0-9]){{11,30}})"
_SECRET = f"(?i:{'|'.join(_KEYS)}) ?[=:] ?\"?[0-9A-Za-z_-]{{12,}}"


def _whole(kind: Kind) -> Kind:
    if kind.name == "iban":
        kind = replace(kind, plain=_IBAN, java=_IBAN)
    if kind.name == "secret":
        kind_gate = kind.gate
        kind = replace(kind, plain=_SECRET, java=_SECRET, gate=lambda t: kind_gate(F.lower(t)))
    # Context words begin at a word's edge.
    return replace(kind, far=True, context=rf"\b(?:{kind.context})")


#: What is found and what is redacted: IBANs end by their country's length, keys may have any case, context goes on across matches.
KINDS = tuple(map(_whole, BASE + ADDED))


def _pieces(text: Column, kind: Kind) -> Column:
    """array<struct<before, value, after, context>>: each match, the text up to the one before and after it, and its context."""
    values = F.regexp_extract_all(text, F.lit(kind.java), F.lit(0))
    between = F.split(text, kind.java, -1)
    n = F.size(values)
    zipped = F.arrays_zip(F.slice(between, F.lit(1), n).alias("before"), values.alias("value"), F.slice(between, F.lit(2), n).alias("after"))
    piece = lambda x, context: F.struct(x["before"].alias("before"), x["value"].alias("value"), x["after"].alias("after"), context.alias("context"))
    if not kind.far:
        return F.transform(zipped, lambda x: piece(x, x["before"]))

    def with_context(pieces: Column, ends: Column) -> Column:
        """A match has a code point at least, so CONTEXT of them before another are enough."""
        return F.transform(pieces, lambda x, i: piece(x, F.right(F.concat(F.array_join(F.slice(ends, F.greatest(F.lit(1), i - CONTEXT + 1), F.least(i, F.lit(CONTEXT))), ""), x["before"]), F.lit(CONTEXT))))

    # One-element arrays bind the matches and their ends to names.
    ends = lambda pieces: F.transform(pieces, lambda x: F.right(F.concat(x["before"], x["value"]), F.lit(CONTEXT)))
    return F.flatten(F.transform(F.array(zipped), lambda p: F.flatten(F.transform(F.array(ends(p)), lambda e: with_context(p, e)))))


def _score(kind: Kind, x: Column) -> Column:
    near = F.lower(F.right(x["context"], F.lit(CONTEXT))).rlike(kind.context)
    return F.when(kind.valid(x["value"], x["before"], x["after"]), F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near, kind.boost).otherwise(0.0))).otherwise(0.0)


_SPAN = "struct<kind: string, start: int, end: int, score: double>"


def _spans(text: Column, kind: Kind) -> Column:
    """array of kind, start, end and score of the matches whose score suffices."""
    measured = F.transform(_pieces(text, kind), lambda x: F.struct(F.length(x["before"]).alias("skip"), F.length(x["value"]).alias("size"), _score(kind, x).alias("score")))

    def placed(block: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def add(s: Column, x: Column) -> Column:
            start = s["at"] + x["skip"]
            span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"), x["score"].alias("score"))
            return F.struct((start + x["size"]).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

        return F.aggregate(block, begin, add, lambda s: s["out"])

    def in_blocks(all_of: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / _BLOCK).cast("int")), lambda b: F.slice(all_of, b * _BLOCK + 1, _BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["skip"] + x["size"]))
        firsts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, firsts, placed))

    # A one-element array binds the matches to a name, so that they are found once.
    bound = F.flatten(F.transform(F.array(measured), lambda m: F.when(F.size(m) > 0, in_blocks(m)).otherwise(F.array().cast(f"array<{_SPAN}>"))))
    found = F.filter(bound, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(kind.gate(text), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, one array of spans (kind, start, end, score) for each kind, by its name)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), text.alias("__text")).select(F.col(id_col), *[_spans(F.col("__text"), k).alias(k.name) for k in kinds])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, kind: Kind) -> Column:
    """text with the spans of a kind replaced by its name in angle brackets."""

    if kind.prior >= LEAST_SCORE:  # no context is needed
        kind = replace(kind, far=False)

    def join(pieces: Column) -> Column:
        parts = F.transform(pieces, lambda x: F.concat(x["before"], F.when(_score(kind, x) >= LEAST_SCORE, F.lit(f"<{kind.name.upper()}>")).otherwise(x["value"])))
        return F.concat(F.array_join(parts, ""), F.element_at(pieces, -1)["after"])

    whole = F.transform(F.array(_pieces(text, kind)), lambda p: F.when(F.size(p) > 0, join(p)).otherwise(text))
    return F.when(kind.gate(text), F.element_at(whole, 1)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with their texts redacted, one kind after the other (secrets and long spans first); null texts stay null."""
    order = [k for n in ("secret", "email", "ip", "iban", "phone", "card", "ssn") for k in kinds if k.name == n] + [k for k in kinds if k.name not in {own.name for own in KINDS}]
    for kind in order:
        docs = docs.withColumn(text_col, redacted(F.col(text_col), kind))
    return docs
