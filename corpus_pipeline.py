"""A corpus from `documents`: each stage works on all that the one before it kept.

Quality rules and the quality classifier drop documents, the n-gram join keeps one
document of each group of near copies, decontamination drops documents that share
a passage with `benchmark`, and packing turns the rest into sequences of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, jaccard_join, packing, quality_qda, quality_rules
from barloom.llm.staging import staged, table

#: Least score of a document that the classifier keeps.
LEAST_SCORE = 0.7


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 9)."""
    return quality_rules.judged(docs).where("kept").select("doc.*")


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores high enough (operator 10).

    It learns from labelled rows of the whole table: the stage's own input lacks
    most of what the rules rejected.
    """
    model = quality_qda.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_qda.scored(docs, model).where(f"score >= {LEAST_SCORE}").select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (operator 4)."""
    return jaccard_join.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item (operator 7)."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens (operator 5)."""
    return packing.packed(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", apply_rules),
    ("quality classifier", apply_classifier),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: A trained model and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
