"""Gridded fields: partitioned long tables, and files of other formats where their libraries are installed."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from skyecho import schema
from skyecho.functions.meteo import celsius
from skyecho.operators.grid import axes, crop, nearest_cells
from skyecho.operators.resample import group_field

#: The axes of a stored field, beside it.
AXES = "variable string, latitude array<double>, longitude array<double>"


def write_field(df: DataFrame, root: str) -> None:
    """A long field laid out by variable and year, which readers prune by, a month to a task; and its axes."""
    df.withColumn("year", F.year("ts")).repartition("variable", "year", F.month("ts")).write.partitionBy("variable", "year").parquet(root)
    axes(df).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}_axes")


def read_axes(spark: SparkSession, root: str) -> DataFrame:
    """The axes that ``write_field`` stored: a row per variable."""
    return spark.read.schema(AXES).parquet(f"{root.rstrip('/')}_axes")


def read_field(spark: SparkSession, root: str, variables: Sequence[str] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Only the folders of the variables and years are listed and read."""
    df = spark.read.schema(schema.FIELD + ", year int").parquet(root)
    if variables is not None:
        df = df.where(F.col("variable").isin(*variables))
    if years is not None:
        df = df.where(F.col("year").between(*years))
    return df.drop("year")


def open_field(spark: SparkSession, root: str, variables: Sequence[str], years: tuple[int, int] | None = None, grouping: str | None = None, domain: tuple[float, float, float, float] | None = None, number: int | None = None) -> DataFrame:
    """A field by period and cell: read, of one ensemble member if given, grouped, cropped to (lat_min, lat_max, lon_min, lon_max)."""
    df = read_field(spark, root, variables, years)
    if number is not None:
        df = df.where(F.col("number") == number)
    if domain is not None:
        known = read_axes(spark, root)
        df = crop(df, *domain, known=known if variables is None else known.where(F.col("variable").isin(*variables)))
    return group_field(df, grouping)


def point_series(spark: SparkSession, root: str, points: DataFrame, variables: Sequence[str], years: tuple[int, int] | None = None, grouping: str | None = None, number: int | None = None, names: dict[str, str] | None = None, kelvin: Sequence[str] = (), metres: Sequence[str] = ()) -> DataFrame:
    """``code, d, variable, value``: the series of the cell nearest to each point (code, latitude, longitude).

    Variables are renamed by ``names``, and get _<number> behind them for an ensemble member; those in ``kelvin`` become degrees
    Celsius and those in ``metres`` millimetres. The axes are those stored with the field, so only the cells' rows are read.
    """
    df = read_field(spark, root, variables, years)
    if number is not None:
        df = df.where(F.col("number") == number)
    known = read_axes(spark, root).where(F.col("variable").isin(*variables))
    at = nearest_cells(points, df, known=known).withColumnsRenamed({"grid_latitude": "latitude", "grid_longitude": "longitude"})
    grouped = group_field(df.join(F.broadcast(at.select("latitude", "longitude").distinct()), ["latitude", "longitude"], "left_semi"), grouping)  # a row per station
    x = F.col("value")
    value = F.when(F.col("variable").isin(*kelvin), celsius(x)).when(F.col("variable").isin(*metres), x * 1000).otherwise(x)
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in (names or {"": ""}).items() for v in pair)), F.col("variable")), F.col("variable"))
    if number is not None:
        name = F.concat(name, F.lit(f"_{number}"))
    return grouped.join(F.broadcast(at), ["latitude", "longitude"]).select("code", "d", name.alias("variable"), value.alias("value"))


def cached(spark: SparkSession, path: str, make: object) -> DataFrame:
    """The table stored at ``path``; where there is none, that of ``make()`` is stored first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def files_of(root: str, variables: Sequence[str], years: Sequence[int], extension: str) -> dict[str, list[str]]:
    """Paths of the layout y_<year>/<year>_<variable><extension>, whether they exist or not."""
    return {v: [f"{root.rstrip('/')}/y_{y}/{y}_{v}{extension}" for y in years] for v in variables}


def found_files(spark: SparkSession, paths: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[str]]:
    """Those of ``files_of`` that exist, in order of path, and the missing ones, which a caller reports."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    there, missing = {}, []
    for variable, own in paths.items():
        there[variable] = []
        for x in sorted(own):
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            (there[variable] if path.getFileSystem(conf).exists(path) else missing).append(x)
    return there, missing


def gridfiles(spark: SparkSession, paths: dict[str, list[str]], number: int | None = None) -> DataFrame:
    """One long field out of the files of all variables; raises when a variable has none."""
    there, missing = found_files(spark, paths)
    if empty := [v for v, own in there.items() if not own]:
        raise FileNotFoundError(f"no file for {', '.join(empty)}; missing: {', '.join(missing)}")
    register(spark)
    df = spark.read.format("gridfiles").option("files", ",".join(f"{v}={x}" for v, own in there.items() for x in own)).load()
    return df if number is None else df.where(F.col("number") == number)


class _File(InputPartition):
    def __init__(self, path: str, variable: str) -> None:
        self.path, self.variable = path, variable


def batches_of(data: object, variable: str, number: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the long field, one per time step (and member), of a dataset with the dimensions
    time (or valid_time), latitude, longitude and perhaps number."""
    import numpy as np

    if "valid_time" in data.coords and "time" not in data.dims:
        data = data.swap_dims({"valid_time": "valid_time"}).rename({"valid_time": "time"}) if "valid_time" in data.dims else data.rename({"valid_time": "time"})
    lat, lon = np.asarray(data["latitude"].values, float), np.asarray(data["longitude"].values, float)
    rows = len(lat) * len(lon)
    members = list(np.atleast_1d(data["number"].values)) if "number" in data.dims else [None]
    for name in data.data_vars:
        field = data[name]
        for k, t in enumerate(np.atleast_1d(data["time"].values)):
            for m, member in enumerate(members):
                own = int(member) if member is not None else int(data["number"].values) if "number" in data.coords else 0
                if number is not None and own != number:
                    continue
                slice_ = field.isel({d: i for d, i in (("time", k), ("number", m)) if d in field.dims}).transpose("latitude", "longitude")
                columns = [
                    pa.array(np.full(rows, np.datetime64(t, "us"))), pa.array(np.repeat(lat, len(lon))), pa.array(np.tile(lon, len(lat))),
                    pa.array([variable] * rows, pa.string()), pa.array(np.full(rows, own, np.int32)), pa.array(np.asarray(slice_.values, np.float32).ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["ts", "latitude", "longitude", "variable", "number", "value"])


class GridFileReader(DataSourceReader):
    """One task per file of a comma-separated list; needs xarray and an engine for the format on the executors. A
    variable and a member that a query asks for are picked before files are opened and slices are read."""

    def __init__(self, options: dict) -> None:
        self.files = [x.split("=", 1) for x in options["files"].split(",") if x]
        self.number: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("variable",):
                self.files = [x for x in self.files if x[0] == f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("number",):
                self.number = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(path, variable) for variable, path in self.files] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        try:
            import xarray
        except ImportError as e:
            raise RuntimeError("reading netCDF or GRIB needs xarray on the executors") from e
        path = partition.path.removeprefix("file://")
        if not os.path.exists(path):
            raise FileNotFoundError(f"{path}: the files must lie where all executors see them")
        with xarray.open_dataset(path) as data:
            yield from batches_of(data, partition.variable, self.number)


class GridFiles(DataSource):
    """spark.read.format("gridfiles").option("files", "var=path,var=path").load()"""

    @classmethod
    def name(cls) -> str:
        return "gridfiles"

    def schema(self) -> str:
        return schema.FIELD

    def reader(self, schema: object) -> DataSourceReader:
        return GridFileReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridFiles)
