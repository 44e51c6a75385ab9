"""The document pipeline: identify languages, judge quality, drop near copies, mix, pack."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from policyscan.llm import language, mixing, near_dedup, packing, quality
from policyscan.llm.tables import materialized, read, unused_name

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_QUALITY = 0.3
#: How often the text of a small source is used at most.
REPETITION = 2.0


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are near enough to a language; learned from the labelled ones."""
    model, found = language.fit(docs), unused_name(docs, "found")
    judged = docs.withColumn(found, language.language(model))
    return judged.where(judged[found]["accepted"]).drop(found)


def judge_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of at least the least quality score; learned from ``labels``."""
    model, found = quality.fit(docs, read(spark, folder, "labels")), unused_name(docs, "score")
    scored = docs.withColumn(found, quality.score(model))
    return scored.where(scored[found] >= LEAST_QUALITY).drop(found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document once, and those of smaller sources again up to the mixture's weights."""
    return mixing.mixed(docs, mixing.Mixture(repetition=REPETITION))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("quality classifier", judge_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the stages that learn; tests compare them with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages one after the other, each reading what the one before it wrote."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
