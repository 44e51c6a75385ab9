"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyscan.llm import (
    extraction,
    language,
    mixing,
    near_dedup,
    packing,
    quality,
    repeated_phrases,
    sharding,
    spelling,
    token_counts,
    vector_dedup,
    vector_search,
    whitening,
)
from policyscan.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24
WINDOW = 1024
TOP = 5
LEAST_QUALITY = 0.3


def _fold(of: int, held_out: int) -> Column:
    """Whether a document is held out; one without an id is not, and is not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == held_out, F.lit(False))


def op1_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"), SHARDS)


def op2_quantised_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.vector_duplicates(read(spark, folder, "embeddings"))


def op3_temperature_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents, how = read(spark, folder, "documents"), mixing.Mixture(repetition=2.0)
    count = mixing.words()
    found = mixing.plan(documents, how, count)
    return mixing.placed(documents, how, found, count)


def op4_approximation_file_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return vector_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), TOP)


def op5_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(read(spark, folder, "documents"), path, WINDOW, special=True)


def op6_nearest_centroid_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").withColumn("held_out", _fold(3, 1))
    model = language.fit(documents.where("not held_out and doc_id is not null"))
    judged = documents.select("doc_id", "held_out", language.language(model).alias("found"))
    return judged.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")


def op7_discriminant_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    learned = read(spark, folder, "labels").where(~_fold(5, 0))
    model = quality.fit(documents, learned)
    scored = documents.select("doc_id", _fold(5, 0).alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_QUALITY).cast("int"))


def op8_viterbi_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return read(spark, folder, "documents").select("doc_id", token_counts.token_count(path).alias("n_tokens"))


def op9_chosen_path_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    how = near_dedup.NearDuplicates(words=4, percent=80)
    return near_dedup.near_duplicates(read(spark, folder, "documents"), how)


def op10_site_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    pages = extraction.with_main_text(read(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_bit_sliced_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    model = whitening.fit(vectors)
    explained = model.explained if model else []
    found = whitening.whiten(vectors, model)
    parts = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return parts.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.rows if model else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


def op12_repeated_phrase_removal(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_phrases.without_repeats(read(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_quantised_vector_duplicates,
        op3_temperature_mixture,
        op4_approximation_file_search,
        op5_sum_of_squares_packing,
        op6_nearest_centroid_language,
        op7_discriminant_quality,
        op8_viterbi_token_counts,
        op9_chosen_path_near_duplicates,
        op10_site_template_removal,
        op11_bit_sliced_whitening,
        op12_repeated_phrase_removal,
        op13_spelling_variants,
    )
}
