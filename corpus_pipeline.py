"""A training corpus from `documents`: toxicity, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.decontamination import remove_documents
from quantloom.llm.minmax import keep_one
from quantloom.llm.mixing import remix
from quantloom.llm.shared import free, scratch, settle, table
from quantloom.llm.sharding import shard
from quantloom.llm.toxicity import learnable, reject_toxic, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold, by a model of the learnable labels."""
    return reject_toxic(docs, train(docs, learnable(table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 over five-word shingles."""
    return keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to twice."""
    return remix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    return shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minmax_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The toxicity model and the bisected exponent are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables that a stage wrote on its way are deleted once its own is there."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
        free(*before)
        before = [docs]
    return docs
