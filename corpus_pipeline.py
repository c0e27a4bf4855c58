"""A corpus pipeline of the operators: language, quality, near duplicates, benchmark passages, mix.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``; each works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tangentia.llm import decontaminate, langid, minhash, mixing, quality
from tangentia.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letter, or too low a calibrated probability."""
    return langid.keep_identified(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a Jaccard of 0.8 or more) stays, the one with the smallest id."""
    return minhash.keep_distinct(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which it takes words, with all their columns, and how many words of each (``taken``, repeats counted)."""
    return mixing.take(docs)


STAGES = [
    ("language", language),
    ("quality", rules),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark),
    ("mix", mix),
]

#: The language stage is a trained model, which SQL can't state; tests hold every other stage against brute force or its SQL,
#: and the language stage against the operator's query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
