"""The corpus pipeline: documents in, token counts and digests of the clean ones out.

Each stage works on all that the one before kept. A stage's result is written as
Parquet in the shared folder and read again, so a stage never runs twice and a lost
executor costs no more than its own stage.

Defined results: null, empty and white texts fail the quality rules and go; null ids stay
null, and near-dedup orders them after all others; of repeated rows one stays; a very long
text is read whole by every stage; ties go to the smallest id; an empty table gives an
empty result; columns beyond those of documents pass through all stages but the last,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import op1_quality, op2_bpe, op4_minhash, op5_decontaminate, op6_pii, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    rules = op1_quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op1_quality.keep(docs, op1_quality.plan(docs, rules))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return op4_minhash.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return op5_decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return op2_bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: SQL cannot express the tokeniser or the searches; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(spark, before)
        before = path
    return docs
