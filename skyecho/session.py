"""A Spark session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "skyecho", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and whatever else is given; master and memory normally come from spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.parquet.filterPushdown", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
