"""From raw documents to packed sequences: the stages are written as Parquet, and each reads what the one before wrote.

All stages but the last keep the columns of their input, whatever their names, and use very long texts whole; null ids and
repeated rows are allowed everywhere, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vivarium.llm import decontaminate, language_id, near_dup, packing, pii
from vivarium.llm.common import read, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts and texts without a letter."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that of the least doc_id; texts without words are classes of their own."""
    return near_dup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of `benchmark`; documents and items without words match nothing."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; no document goes."""
    return pii.mask_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences: a row per piece, at least one for each document."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("pii", private), ("packing", packed)]

#: The stages train models and hash shingles, which SQL doesn't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the table `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
