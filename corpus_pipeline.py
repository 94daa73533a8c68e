"""The corpus pipeline: each stage applies one training-data operator to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, language, minhash, packing
from strandloom.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose letters no mixture of the learnt languages explains, go."""
    model = language.learn(docs)
    return language.keep_identified(docs, model, limit=language.clean_limit(docs, model))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, 80 % similarity."""
    return minhash.keep_representatives(docs, width=5)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training windows, with their ids."""
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [("language", identify_language), ("near_duplicates", remove_near_duplicates), ("benchmarks", remove_benchmarks), ("packing", pack_windows)]

#: The stages learn models and run automata over words, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
