"""Views of the benchmark tables as observations, fields and component spaces, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weather() -> list[Column]:
    p = F.col("o_totalprice")
    return [(F.avg(p) / 9973.1 - 10).alias("tmean"), (F.max(p) / 9973.1 - 20).alias("tmax"), (F.min(p) / 9973.1 - 5).alias("tmin"), F.greatest(F.lit(0.0), F.sum(p) / 99731.7 - 14).alias("pcp")]


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(*_weather())


def station_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("station"), F.to_date("o_orderdate").alias("d")).agg(*_weather())


_WEATHER_SQL = "avg(o_totalprice) / 9973.1 - 10 AS tmean, max(o_totalprice) / 9973.1 - 20 AS tmax, min(o_totalprice) / 9973.1 - 5 AS tmin, greatest(0.0, sum(o_totalprice) / 99731.7 - 14) AS pcp"
DAILY = f"daily AS (SELECT CAST(o_orderdate AS DATE) AS d, {_WEATHER_SQL} FROM orders GROUP BY 1)"
STATION = f"daily AS (SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS d, {_WEATHER_SQL} FROM orders GROUP BY 1, 2)"


def subdaily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-daily values with a fifth of them missing."""
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_type").alias("station"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


SUBDAILY = "sub AS (SELECT ts, event_type AS station, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables on a grid of 3 latitudes and 2 longitudes."""
    line = table(spark, sf_dir, "lineitem")
    lat = F.when(F.col("l_returnflag") == "A", 50.0).when(F.col("l_returnflag") == "N", 40.0).otherwise(30.0)
    lon = F.when(F.col("l_linestatus") == "F", -10.0).otherwise(-5.0)
    cells = line.groupBy(F.to_date("l_shipdate").alias("d"), lat.alias("latitude"), lon.alias("longitude")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("r"))
    return cells.unpivot(["d", "latitude", "longitude"], ["q", "r"], "variable", "value")


_CELLS = "cells AS (SELECT CAST(l_shipdate AS DATE) AS d, CASE l_returnflag WHEN 'A' THEN 50.0::DOUBLE WHEN 'N' THEN 40.0::DOUBLE ELSE 30.0::DOUBLE END AS latitude, CASE l_linestatus WHEN 'F' THEN -10.0::DOUBLE ELSE -5.0::DOUBLE END AS longitude, avg(l_quantity) AS q, avg(l_discount) AS r FROM lineitem GROUP BY 1, 2, 3)"
FIELD = f"{_CELLS}, field AS (SELECT d, latitude, longitude, 'q' AS variable, q AS value FROM cells UNION ALL SELECT d, latitude, longitude, 'r', r FROM cells)"


def pc_space(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """A component space: the label is the season, the id the day."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("season"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias("d"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"pc_{i}") for i in range(n)))


def pc_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations of two variables on the days of the component space, every ninth missing."""
    e = table(spark, sf_dir, "embeddings").select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias("d"), "vec_id")
    a, b = F.when(F.col("vec_id") % 9 != 0, (F.col("vec_id") * 37 % 101).cast("double")), F.when(F.col("vec_id") % 9 != 0, (F.col("vec_id") * 53 % 17).cast("double"))
    return e.select("d", a.alias("a"), b.alias("b")).unpivot(["d"], ["a", "b"], "variable", "value").where("value is not null")


def pc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations of two variables that are missing (null) on different days."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int"))
    a, b = (F.when(F.col("vec_id") % gap != 0, (F.col("vec_id") * k % m).cast("double")) for gap, k, m in ((9, 37, 101), (7, 53, 17)))
    return table(spark, sf_dir, "embeddings").select(day.alias("d"), a.alias("a"), b.alias("b")).unpivot(["d"], ["a", "b"], "variable", "value")


def pc_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias("d"), (F.col("vec_id") * 29 % 83).cast("double").alias("value"))


PC = "space AS (SELECT label AS season, DATE '2000-01-01' + CAST(vec_id AS INTEGER) AS d, CAST(embedding AS DOUBLE[]) AS pc, vec_id FROM embeddings)"
PC_OBSERVED = "long AS (SELECT DATE '2000-01-01' + CAST(vec_id AS INTEGER) AS d, 'a' AS variable, CAST(vec_id * 37 % 101 AS DOUBLE) AS value FROM embeddings WHERE vec_id % 9 <> 0 UNION ALL SELECT DATE '2000-01-01' + CAST(vec_id AS INTEGER), 'b', CAST(vec_id * 53 % 17 AS DOUBLE) FROM embeddings WHERE vec_id % 9 <> 0)"
PC_GAPS = "long AS (SELECT DATE '2000-01-01' + CAST(vec_id AS INTEGER) AS d, 'a' AS variable, CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id * 37 % 101 AS DOUBLE) END AS value FROM embeddings UNION ALL SELECT DATE '2000-01-01' + CAST(vec_id AS INTEGER), 'b', CASE WHEN vec_id % 7 <> 0 THEN CAST(vec_id * 53 % 17 AS DOUBLE) END FROM embeddings)"
PC_MAPPING = "mapping AS (SELECT DATE '2000-01-01' + CAST(vec_id AS INTEGER) AS d, CAST(vec_id * 29 % 83 AS DOUBLE) AS value FROM embeddings)"


def models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The observed mean temperature (every eleventh day missing) and three models of it."""
    d = daily_obs(spark, sf_dir)
    obs = d.select("d", F.when(F.dayofyear("d") % 11 != 0, F.col("tmean")).alias("value"))
    kinds = {"mid": (F.col("tmax") + F.col("tmin")) / 2, "low": F.col("tmin") + 12, "high": F.col("tmax") - 9}
    wide = d.select("d", *(c.alias(n) for n, c in kinds.items()))
    return obs, wide.unpivot(["d"], list(kinds), "model", "value")


MODELS = f"{DAILY}, obs AS (SELECT d, CASE WHEN dayofyear(d) % 11 <> 0 THEN tmean END AS value FROM daily), models AS (SELECT d, 'mid' AS model, (tmax + tmin) / 2 AS value FROM daily UNION ALL SELECT d, 'low', tmin + 12 FROM daily UNION ALL SELECT d, 'high', tmax - 9 FROM daily)"


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})
