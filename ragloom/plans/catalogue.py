"""Queries of the retrieval operators and the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.plans import chunks, evaluation, retrieval, stores, texts
from ragloom.plans.registry import QUERIES, SQL, Query

MODULES = (texts, chunks, stores, retrieval, evaluation)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.strategy_comparison(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
