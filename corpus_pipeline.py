"""The corpus pipeline: stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; the last returns the documents
of the mix with their size, target and words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from passagelake.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees do not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id."""
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document has; texts that lose
    all their words go."""
    cut = suffix_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").rlike(mixing.WORD))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, and the other columns of
    the documents of which it takes words (``docs_<name>`` for a column that has the name
    of one of these)."""
    mixed = mixing.mix_sources(docs, keep=[c for c in docs.columns if c != "doc_id"])
    return mixed.where("taken > 0")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_to_weights", mix_to_weights),
]

#: SQL has no XXH64, no trees and no edit search over windows: tested by parts
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
