"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loantide.llm import decontaminate, line_dedup, mixing, quality, simhash
from loantide.llm.common import drop_stored, stored, table
from loantide.llm.registry import own_folder_where_unset


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out fold, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(docs, model) >= 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; windows of three lines that stand earlier are gone from their texts."""
    return line_dedup.drop_repeated_lines(docs, count_column=None)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: shingles of four words, four bits."""
    return simhash.drop_near_copies(docs, length=4, bits=4)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, by source."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix),
]

#: The classifier and SimHash have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    own_folder_where_unset(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
