"""Continuous versions: daily values of a stream of observations, and analogs of new days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from skyecho.functions.values import aggregate, finite
from skyecho.operators.analogs import analog_pool


def read_observations(spark: SparkSession, root: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive under ``root``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(root)


def daily(stream: DataFrame, how: str = "mean", keys: tuple[str, ...] = ("station", "variable"), ts: str = "ts", delay: str = "2 days", skipna: bool = True) -> DataFrame:
    """Each closed day's aggregate. Observations later than ``delay`` are dropped, where the batch version recomputes."""
    if how == "median":
        raise ValueError("a median can't be kept up incrementally")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = timed.groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(aggregate(how, finite("value"), skipna).alias("value"))
    return out.select(F.to_date("w.start").alias("d"), *keys, "value")


def analogs_of_new_days(stream: DataFrame, pcs: DataFrame, observed: DataFrame, sink: Callable[[DataFrame, int], None], size: int = 100, vw_size: int = 10, distance: str = "euclidean") -> DataStreamWriter:
    """For each micro-batch of new days (season, d, pc_0 ..), the pool out of the stored days, given to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["season", "d"])
        both = pcs.join(new.select("season", "d"), ["season", "d"], "left_anti").unionByName(new.select(*pcs.columns))
        sink(analog_pool(both, observed.join(new.select("d"), "d", "left_anti"), new.select("d"), size, vw_size, distance=distance), number)

    return stream.writeStream.foreachBatch(each)
