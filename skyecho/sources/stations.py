"""Station metadata and observation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho import schema
from skyecho.functions.values import finite
from skyecho.operators.grid import nearest_cells
from skyecho.operators.resample import daily_variables


def stations(spark: SparkSession, root: str) -> DataFrame:
    """The first data row of every <root>/<station>/meta.csv."""
    rows = spark.read.schema(schema.STATIONS).csv(f"{root}/*/meta.csv", header=True)
    # One file holds one station; of further rows none counts.
    first = rows.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    return first.groupBy("_file").agg(F.min_by(F.struct("code", "name", "longitude", "latitude", "altitude"), "_at").alias("s")).select("s.*")


def station(spark: SparkSession, path: str) -> DataFrame:
    """One station's metadata."""
    return spark.read.schema(schema.STATIONS).csv(f"{path.rstrip('/')}/meta.csv", header=True).limit(1)


def observations(spark: SparkSession, root: str, variables: Sequence[str], station: str = "*", exact: bool = True) -> DataFrame:
    """Long observations out of <root>/<station>/<VARIABLE>.csv (a time and a value column).

    Files count by their whole stem; with ``exact`` false by any that contains a
    variable's name, the established rule. Raises when there is none.
    """
    names = [f"{v}.csv" if exact else f"*{v}*.csv" for v in variables]
    raw = spark.read.schema("ts string, value string").csv([f"{root.rstrip('/')}/{station}/{n}" for n in names], header=True)
    path = F.col("_metadata.file_path")
    out = raw.select(F.element_at(F.split(path, "/"), -2).alias("station"), F.try_to_timestamp("ts").cast("timestamp_ntz").alias("ts"), F.regexp_extract(path, r"([^/]+)\.csv$", 1).alias("variable"), finite(F.expr("try_cast(value AS double)")).alias("value"))
    return out.where(F.col("ts").isNotNull() & (F.col("variable") != "meta"))


def wide(observations_: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One column per variable; the list given makes the pivot a single aggregation."""
    return observations_.groupBy("station", "ts").pivot("variable", list(variables)).agg(F.first("value"))


def daily(spark: SparkSession, root: str, variable: str, station: str = "*", skipna: bool = True, grouping: str = "mean") -> DataFrame:
    """Daily columns of a variable of one or all stations."""
    return daily_variables(wide(observations(spark, root, [variable], station), [variable]), keys=("station",), skipna=skipna, grouping=grouping)


def write_observations(df: DataFrame, root: str) -> None:
    """Long observations as one folder per station and variable."""
    df.select("station", "variable", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value").write.partitionBy("station", "variable").option("header", True).csv(root)


class Station:
    """Metadata of one station and its data."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        row = station(spark, path).first()
        if row is None:
            raise ValueError(f"no metadata in {path}")
        self.spark, self.path = spark, path.rstrip("/")
        self.code, self.name = row["code"], row["name"]
        self.longitude, self.latitude, self.altitude = row["longitude"], row["latitude"], row["altitude"]

    def get_data(self, variable: str, skipna: bool = True) -> DataFrame:
        root, _, name = self.path.rpartition("/")
        return daily(self.spark, root, variable, name, skipna)

    def get_gridpoint(self, grid: DataFrame) -> DataFrame:
        point = self.spark.createDataFrame([(self.code, float(self.latitude), float(self.longitude))], "code string, latitude double, longitude double")
        return nearest_cells(point, grid)
