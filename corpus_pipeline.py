"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding; each stage a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontamination, mixing, quality, sharding, simhash
from quadrille.llm.common import Table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser-fertility rules reject go."""
    return quality.filter_quality(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn so that sources have their target weights; a document drawn twice has two rows."""
    return mixing.mix_sources(docs).select(*docs.columns)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
    ("shard", into_shards),
]

#: Fertility needs a tokenizer, and graph search has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else Table(out, f"pipeline_{name}").df
    return docs
