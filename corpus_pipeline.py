"""The corpus pipeline: documents go through the stages in order, each written and read again."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchlake.llm import decontamination, jaccard, mixing, sharding, toxicity
from matchlake.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not predicted toxic."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by shingle Jaccard of 0.75 or more."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), keep_columns=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated (or left out) as the target weights ask."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size, checksum, shard and slot of every row."""
    return sharding.sharded_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", keep_one_of_each), ("decontamination", drop_leaks),
          ("mixing", mix_sources), ("sharding", shard)]
ORACLE_SQL = None  # votes, edit distances and sampled splits are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
