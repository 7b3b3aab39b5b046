"""One registered query per operator, over the whole of its table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm import byte_bpe, fingerprints, languages, near_duplicates, neighbours, packing, personal_data, quality, repeated_passages, resampling, sql, token_counts, toxicity, vector_codes
from pitchframe.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op11_vector_codes": sql.VECTOR_CODES,
    "op12_quality_rules": sql.QUALITY_RULES,
    "op13_importance_resampling": sql.IMPORTANCE_RESAMPLING,
}


def register(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


@register
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    lexicon = toxic_lexicon(spark, documents, folder)
    out = toxicity.scores(documents, lexicon, 0.7)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def toxic_lexicon(spark: SparkSession, documents: DataFrame, folder: str) -> toxicity.Lexicon:
    """Learned from the labelled documents that are not held out."""
    labels = table(spark, folder, "labels").where(~toxicity.held_out(F.col("doc_id"), 3, 1))
    return toxicity.learn(toxicity.labelled_sample(documents, labels))


@register
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The cache starts empty, so every distinct text is encoded once."""
    documents = table(spark, folder, "documents")
    return token_counts.token_counts(documents, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "counts"), 2048)


@register
def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@register
def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages.repeated_passages(table(spark, folder, "documents"), 50, 5, (80, 100))


@register
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), 3, (85, 100))


@register
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, folder, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(personal_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal_data.joined("base"), 256).alias("base_sha256"), personal_data.joined("spans").alias("spans"))


@register
def op8_languages(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = toxicity.held_out(F.col("doc_id"), 4, 2)
    found = languages.languages(documents, languages.learn(documents.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@register
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.coded_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, folder, "embeddings"), 16, 64, 2)


@register
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality(table(spark, folder, "documents"))
    return found.withColumns({name: F.round(name, 9) for name in ("class_distance", "word_distance")})


@register
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"), (1, 1), 10_000, 10, 20, 2024)
