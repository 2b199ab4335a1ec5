"""From raw documents to a training mix, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from solvetrail.llm import decontaminate, exact, language, mixing, simhash
from solvetrail.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a letter, or in no language that the labelled ones teach, go.

    Null and empty texts have no letter. Ties between languages go to the first by name. Repeated rows stay or go
    together. Of an empty table, or one without labels, nothing stays. Other columns are carried along.
    """
    return language.identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts stays.

    The longest original stays, then the smallest id, nulls last; of repeated rows one. Null texts equal empty
    ones. An empty table stays empty, other columns are carried along.
    """
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, nulls last.

    Texts without words are near copies of each other, and of whatever has few bits set. Of repeated rows one stays.
    An empty table stays empty, other columns are carried along.
    """
    return simhash.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with too much of the benchmark go.

    Null and empty texts have no words and stay. Repeated rows stay or go together. An empty benchmark takes
    nothing away. Other columns are carried along.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the mix takes, with how often: mix_size, mix_target, mix_times.

    Null and empty texts have no words, so they are not taken. Rows without source are one source. Repeated rows
    come as one row with the times of all. Where a column bears one of the new names already, the new one
    gets a '_' behind it. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mix),
]

# SQL has no trained classifier, no XXH64 and no balanced sampling.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, folder), f"stage-{place}")
        if place:
            scratch.drop(f"stage-{place - 1}")
    return docs
