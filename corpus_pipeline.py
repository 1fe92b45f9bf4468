"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes what its predecessor kept and returns the columns of documents; the last one adds where each row goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import classifier, decontam, mixing, ngram_join, sharding
from riskframe.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on labelled rows of the input, rejects."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group; of rows that repeat it, one."""
    return ngram_join.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where(F.size("spans") == 0).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; documents it doesn't take go."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with size, text_crc32, law, shard and slot."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if last is not source:
            scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither a trained classifier nor a minimax cut is within SQL's reach; tests compare with brute force.
ORACLE_SQL = None
