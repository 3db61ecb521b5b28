"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.llm import (
    centroids, decontamination, html_text, language_id, lm_scoring, packing, quality, sharding, simhash, substring_dedup, toxicity,
    url_filter, vector_codes,
)
from emberscope.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.held_out_languages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@_register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_sentences"))


@_register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@_register
def op4_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, from the stored ledger."""
    return quality.ablations(quality.stored_ledger(table(spark, sf_dir, "documents")))


@_register
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_register
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


@_register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@_register
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.visible_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@_register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.held_out_scores(table(spark, sf_dir, "documents"))


@_register
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


@_register
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


@_register
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings")).drop("centroid")
