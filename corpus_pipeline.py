"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, zstd_quality
from tokenloom.llm.common import crc_mod
from tokenloom.session import materialize

#: Near copies share 80 % of their runs of five words; op7's three words and 90 % are that query's own.
NEAR_WIDTH, NEAR_SHARE = 5, 80


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns as op10 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return zstd_quality.keep_good(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return jaccard_join.keep_one_of_each(docs, width=NEAR_WIDTH, share=NEAR_SHARE)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per taken copy: the document, then copy, shard and place in the shard."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_classifier", judge_quality),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The classifier and the seeded draws have no SQL twin; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
