"""One row per group by an order: latest indexes, jobs and pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group."""
    out = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n)
    return out.withColumnRenamed("__rank", rank) if rank else out.drop("__rank")


def usable(indexes: DataFrame) -> DataFrame:
    return indexes.filter(F.col("status").isin("READY", "PARTIAL"))


def latest_index(indexes: DataFrame) -> DataFrame:
    """By organisation, repository and revision the index that was last indexed, or updated where that is unknown."""
    seen = F.coalesce("indexed_at", "updated_at")
    return top(usable(indexes), ["org_id", "repo_id", "revision"], [seen.desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("id").desc()])


def active_index(indexes: DataFrame) -> DataFrame:
    """By repository and revision the last updated index; a missing index time comes first, as it does in the service."""
    return top(usable(indexes), ["repo_id", "revision"], [F.col("updated_at").desc_nulls_first(), F.col("indexed_at").desc_nulls_first(), F.col("id").desc()])


def active_graph(indexes: DataFrame) -> DataFrame:
    ready = indexes.filter(F.col("status") == "READY")
    return top(ready, ["repo_id", "revision"], [F.col("indexed_at").desc_nulls_first(), F.col("updated_at").desc_nulls_first(), F.col("id").desc()])


def latest_job(jobs: DataFrame) -> DataFrame:
    return top(jobs, ["repo_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()])


def failed_per_parent(subjobs: DataFrame) -> DataFrame:
    return top(subjobs.filter(F.col("status") == "FAILED"), ["job_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()])
