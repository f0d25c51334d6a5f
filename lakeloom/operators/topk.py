"""Sorting and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_by(df: DataFrame, column: str, tie: Sequence[str], n: int) -> DataFrame:
    """The ``n`` largest rows; each task forwards at most ``n`` of its own."""
    return df.orderBy(F.col(column).desc(), *tie).limit(n)


def top_customers(lifetime: DataFrame, n: int = 10) -> DataFrame:
    return top_by(lifetime, "lifetime_value", ["customer_id"], n)


def top_features(features: DataFrame, n: int = 100) -> DataFrame:
    return top_by(features, "f", ["id"], n)


def sorted_report(df: DataFrame, key: str) -> DataFrame:
    """Total order on the group key, by range partitioning."""
    return df.orderBy(key)


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.col("run_id").desc()).limit(limit)
