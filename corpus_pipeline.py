"""A training corpus from raw documents: quality, near duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presslake.llm import decontaminate, mixing, neardup, quality, sharding
from presslake.session import discard, scratch

#: Similarity of near duplicates in the pipeline, in percent; the query op5_near_duplicates has its own.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no learned rule rejects."""
    rules = quality.learn_from(docs, _table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of NEAR_PERCENT or more."""
    return neardup.one_of_each(docs, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mix", mixed),
    ("shards", sharded),
]
#: Learned rules and similarity components are not for SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it; what a stage has read or staged goes once it is written."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read = docs
        with scratch(spark) as keep:
            docs = keep(stage(spark, read, sf_dir))
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
