"""All queries of the retrieval library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import oracle
from .plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in plans.ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked and diversified passages of each benchmark query."""
    return plans.mmr_topk(spark, sf_dir)
