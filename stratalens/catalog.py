"""Registered queries of the audit operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import audit, registry, relational  # noqa: F401  (importing registers)
from .queries.registry import Query


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional G2, mean disparity and regression LRT of orders with permutation p-values (B = 999)."""
    return audit.grouped_permutation_test(spark, sf_dir)
