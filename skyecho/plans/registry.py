"""All registered queries: name to plan, and name to the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyecho.plans import queries_space, queries_time

FLAGSHIP = "recon_closest"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(queries_time.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(queries_time.SQL)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The analog reconstruction by the nearest day, over the smallest tables."""
    return queries()[FLAGSHIP](spark, sf_dir)


__all__ = ["entry", "oracle_sql", "queries", "queries_space"]
