"""A training-data pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmark items, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideblock.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from tideblock.llm.frames import table
from tideblock.scratch import keep


def reject_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of the input, doesn't reject."""
    return quality.accepted(docs, table(spark, folder, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The smallest id of each group of similarity 0.8 or more over runs of five words."""
    return near_dedup.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words of passages that an earlier document has are taken out."""
    return substring_dedup.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of power-of-two lengths with their token ids."""
    return packing.pieces(docs)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

# A trained classifier and a tokenizer have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order; each result but the last is written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
