"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
all but the last return the columns of documents. Null or empty texts fail the quality
stage; every stage judges each row by itself, whether its doc_id is repeated or null; empty
tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import decontam, mixing, near_dedup, quality, sharding
from freshet.llm.shared import Stage, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no rule of the cascade rejects."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id, null last, of equal ones the first."""
    return near_dedup.drop_near_duplicates(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of each, as the mix takes."""
    return mixing.apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return sharding.kd_shards(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# Near-duplicates, window fingerprints and tree cuts are no SQL; see the brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again, and go once the next are."""
    stage = Stage(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for name, step in STAGES:
        docs = stage.keep(step(spark, docs, sf_dir), name)
        if before is not None:
            stage.drop(before)
        before = docs
    return docs
