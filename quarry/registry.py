"""Named queries of the engine, and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import catalog, catalog_build, catalog_context, catalog_evidence, catalog_graph, catalog_harness, catalog_ingest, catalog_matches, catalog_search, catalog_state  # noqa: F401  (the others add their queries to the first)

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["symbol_definitions"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
