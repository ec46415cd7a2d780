"""A training-data pipeline: each stage works on all rows that the one before it kept.

Every stage takes null texts and ids, empty and very long texts, repeated rows, empty tables and columns of any
name; all but the last give the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identification rejects go; so do null, empty and letterless texts, which have
    no language. Repeated rows go or stay together. An empty table stays empty."""
    from factorlab.llm import language

    return language.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the n-gram Jaccard join links, the document with the smallest doc_id stays (a null one only
    if all are null). Texts without words are in no group and stay. An empty table stays empty."""
    from factorlab.llm import jaccard

    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null and empty texts have none and stay. An empty table stays empty."""
    from factorlab.llm import decontamination

    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all, once or twice. A null source is one of its
    own; null texts have size 0. An empty table stays empty."""
    from factorlab.llm import mixing

    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it; equal texts share a shard. An empty table gives no rows."""
    from factorlab.llm import sharding

    return sharding.shard(docs, 16, carry=tuple(docs.columns))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Language identification learns its model; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorlab.llm import shared

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
