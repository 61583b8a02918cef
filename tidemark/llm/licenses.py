"""Licence notices by a positional index of rare words.

Notices and phrases are word sequences with places. Document frequencies of the notices' words are counted over the
whole corpus; of each notice the `rare` words of highest IDF are indexed with their places, and the words of its
mandatory key phrases. A file's words look the index up; postings that agree on file place minus notice place stand
for one alignment. A notice is found where its aligned rare words have `least_score` of its rare weight and every
key phrase stands whole in the same alignment. Fixed phrases are found where all their words align.

Everything is DataFrame functions: words of files without any indexed word are never exploded, the index is a
broadcast table of as many rows as the notices have words, and only (file, notice, alignment) sums are shuffled.

Defined results: null is the empty text; repeated rows are rows of their own; without documents or matches there
are no labels, no places and score 0; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words once A-Z are lower-cased, and one such character before that.
_GAP, _RAW_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Notice:
    """A licence notice: its text, and the phrases that must stand in it."""

    label: str
    text: str
    keys: tuple[str, ...]


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = (
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "licensed under the mit license", ("mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free", "person obtaining")),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Notice("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Notice("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Notice("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("without fee", "hereby granted")),
    Notice("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Notice("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Notice("proprietary", "copyright all rights reserved unauthorized copying of this file is strictly prohibited", ("unauthorized copying", "strictly prohibited")),
    Notice("public-domain", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Score of a file that only a fixed phrase was found in.
PHRASE_SCORE = 0.5


@dataclass(frozen=True)
class Config:
    rare: int = 5
    least_score: float = 0.6


def words(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased."""
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def vocabulary(notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES) -> list[str]:
    return sorted({w for t in (*(n.text for n in notices), *phrases) for w in t.split()})


def _lowered(text: Column) -> Column:
    """Lower-cased beyond A-Z, which is fast and can add matches to a cheap test but loses none."""
    return F.lower(text)


def document_frequencies(docs: DataFrame, vocab: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that have each word of vocab. Word counts go to the driver, no more than vocab has."""
    own = F.array_intersect(F.split(_lowered(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _GAP), F.array(*map(F.lit, vocab)))
    rows = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    found = {r["w"]: r["n"] for r in rows}
    return found.pop("", 0), found


def _places(text: list[str], phrase: str) -> set[int]:
    p = phrase.split()
    at = next(i for i in range(len(text)) if text[i : i + len(p)] == p)
    return set(range(at, at + len(p)))


def postings(total: int, df: dict[str, int], config: Config = Config(), notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES) -> list[tuple]:
    """(word, entry, place, weight, must) of the indexed words: entries are notices, then phrases. Weights are shares of an entry's whole."""
    out = []
    for k, n in enumerate(notices):
        text = n.text.split()
        # ln((1 + N) / (1 + df)), compared by df: the rarest words, ties by the word.
        rare = sorted(set(text), key=lambda w: (df.get(w, 0), w))[: config.rare]
        must = set().union(*(_places(text, p) for p in n.keys))
        idf = {w: _idf(total, df.get(w, 0)) for w in rare}
        whole = sum(idf[w] for w in text if w in idf) or 1.0
        out += [(w, k, i, idf.get(w, 0.0) / whole, int(i in must)) for i, w in enumerate(text) if w in idf or i in must]
    for k, p in enumerate(phrases, len(notices)):
        out += [(w, k, i, 0.0, 1) for i, w in enumerate(p.split())]
    return out


def _idf(total: int, df: int) -> float:
    return round(math.log((1 + total) / (1 + df)), 6)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = Config(), notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(id, n_words, places, found): places: array of (label, first word) of fixed phrases; found: array of (label, first word, score) of notices.

    A file may have many of either; both are arrays of one file's own matches.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total, df = document_frequencies(docs, vocabulary(notices, phrases), text_col)
    index = postings(total, df, config, notices, phrases)
    # A file with an entry has the rarest of the entry's mandatory words.
    firsts = {e: min((p[0] for p in index if p[1] == e and p[4]), key=lambda w: (df.get(w, 0), w)) for e in {p[1] for p in index}}
    cheap = F.split(_lowered(text), _GAP)
    gate = F.arrays_overlap("c", F.array(*map(F.lit, sorted(set(firsts.values())))))
    edge = F.when(F.col("t") == "", 1).otherwise(F.left("t", F.lit(1)).rlike(_RAW_GAP).cast("int") + F.right("t", F.lit(1)).rlike(_RAW_GAP).cast("int"))
    rows = materialise(
        docs.select(F.col(id_col), text.alias("t"), cheap.alias("c"), F.monotonically_increasing_id().alias("rid"))
        .withColumn("n_words", (F.size("c") - edge).cast("bigint"))
        .withColumn("w", F.when(gate, words(F.translate("t", _UPPER, _LOWER))))
        .select(id_col, "rid", "n_words", "w"),
        "words",
    )
    labels = [n.label for n in notices] + list(phrases.values())
    table = spark.createDataFrame(index, "w string, e int, p int, weight double, must int")
    needs = [sum(p[4] for p in index if p[1] == e) for e in range(len(labels))]
    entries = spark.createDataFrame([(e, x, needs[e], e >= len(notices)) for e, x in enumerate(labels)], "e int, label string, need int, phrase boolean")
    aligned = (
        rows.where("w IS NOT NULL")
        .select("rid", F.posexplode("w").alias("at", "w"))
        .join(F.broadcast(table), "w")
        .groupBy("rid", "e", (F.col("at") - F.col("p")).alias("start"))
        .agg(F.round(F.sum("weight"), 6).alias("score"), F.sum("must").alias("must"))
        .join(F.broadcast(entries), "e")
        .where((F.col("must") == F.col("need")) & (F.col("phrase") | (F.col("score") >= config.least_score)))
    )
    place = F.struct("label", F.col("start").cast("bigint").alias("start"))
    notice = F.struct("label", F.col("start").cast("bigint").alias("start"), F.least(F.lit(1.0), "score").alias("score"))
    own = aligned.groupBy("rid").agg(F.collect_list(F.when(F.col("phrase"), place)).alias("places"), F.collect_list(F.when(~F.col("phrase"), notice)).alias("found"))
    light = rows.select(id_col, "rid", "n_words")
    none = F.array()
    return light.join(own, "rid", "left").select(id_col, "n_words", F.coalesce("places", none.cast("array<struct<label: string, start: bigint>>")).alias("places"), F.coalesce("found", none.cast("array<struct<label: string, start: bigint, score: double>>")).alias("found"))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scores(places: Column, found: Column) -> Column:
    """The best notice's score, PHRASE_SCORE for a phrase only, else 0."""
    return F.greatest(F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0)), F.when(F.size(places) > 0, PHRASE_SCORE).otherwise(0.0))
