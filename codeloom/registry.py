"""Registered queries of the code-graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import archive_queries, graph_queries, index_queries, more_queries, resolution_queries, source_queries, text_queries, traversal_queries, upkeep_queries  # noqa: F401  register their queries
from codeloom.plans.registered import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites, resolved first, of every symbol."""
    return QUERIES["agg_02_site_counts"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
