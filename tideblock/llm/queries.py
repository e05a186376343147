"""Registered queries of this subpackage: name to (build, SQL or None). Each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideblock.llm import ann, decontaminate, language_id, lexical, lm_score, merkle, near_dedup, packing, quality, substring_dedup, token_counts, top_k, toxicity
from tideblock.llm.frames import table


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(table(spark, folder, "documents"))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scores(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_exact_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.top_k(table(spark, folder, "embeddings"), "vec_id % 50 = 0")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pieces(table(spark, folder, "documents"), ids=False)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removals(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_lm_scoring": (op2_lm_scoring, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_minhash_near_dedup": (op4_minhash_near_dedup, near_dedup.SQL),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, decontaminate.SQL),
    "op6_exact_topk_search": (op6_exact_topk_search, top_k.SQL),
    "op7_packing": (op7_packing, None),
    "op8_substring_dedup": (op8_substring_dedup, substring_dedup.SQL),
    "op9_token_counts": (op9_token_counts, None),
    "op10_quality_classifier": (op10_quality_classifier, None),
    "op11_ranked_lexical_search": (op11_ranked_lexical_search, lexical.SQL),
    "op12_approximate_neighbours": (op12_approximate_neighbours, None),
    "op13_merkle_manifest": (op13_merkle_manifest, merkle.SQL),
}
