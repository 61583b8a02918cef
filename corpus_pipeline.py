"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next.

Defined results, for every stage: rows are told apart by themselves, so null and repeated ids stay apart and repeated
rows are treated alike (near_dedup keeps one of them); other columns pass through, whatever their names, up to encoding,
which returns its own; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, pii, simhash
from tidemark.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay; texts that are null, without a letter or ambiguous go.

    Ties go to the language that sorts first. Without a labelled row to learn from no language is known, so all go.
    """
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; links are five-word similarities of 0.8 and more.

    Null ids come last; rows of one id are told apart by a written number. Null and word-free texts are one group.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item stands go; null and word-free texts stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is replaced by its kind, and n_chars follows; null texts stay null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether their bytes are the text's; a null text is empty."""
    found = bpe.encode(docs.select("doc_id", "text", "lang", "source"), outputs=("token_ids", "decoded"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: None: SQL can't express the trained network, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
