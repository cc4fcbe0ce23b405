"""Gridded fields in long form: nearest cells, crops, mosaics, vectors, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyecho.functions.calendar import WHOLE_YEAR, with_season
from skyecho.functions.meteo import vector_module
from skyecho.semantics import REFERENCE, is_reference


def axis(df: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """The distinct coordinates of an axis with their places from 0. An axis has thousands of
    values at most: they are counted in one task."""
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    return values.agg(F.sort_array(F.collect_list(name), asc=not descending).alias("v")).select(F.posexplode("v").alias("i", name))


def nearest_index(axis_: DataFrame, name: str, point: float | Column) -> Column:
    """Aggregate: the place of the coordinate nearest to the point, ties to the first."""
    at = point if isinstance(point, Column) else F.lit(float(point))
    return F.min_by("i", F.struct(F.abs(F.col(name) - at), F.col("i")))


def nearest_gridpoint(grid: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """One row: places and coordinates of the nearest cell, each axis on its own (latitudes from north to south)."""
    lat, lon = axis(grid, "latitude", descending=True), axis(grid, "longitude")
    a = lat.agg(nearest_index(lat, "latitude", latitude).alias("ilat"), F.min_by("latitude", F.struct(F.abs(F.col("latitude") - latitude), "i")).alias("latitude"))
    b = lon.agg(nearest_index(lon, "longitude", longitude).alias("ilon"), F.min_by("longitude", F.struct(F.abs(F.col("longitude") - longitude), "i")).alias("longitude"))
    return a.withColumn("_1", F.lit(1)).join(b.withColumn("_1", F.lit(1)), "_1").drop("_1")


def axes(grid: DataFrame) -> DataFrame:
    """``latitude`` and ``longitude`` (sorted arrays) by variable: one row each, out of one scan. ``write_field`` stores this
    table beside a field, so that later readers need no scan at all."""
    names = ["variable"] if "variable" in grid.columns else []
    both = [F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in ("latitude", "longitude")]
    return grid.groupBy(*names).agg(*both)


def _axes(grid: DataFrame, known: DataFrame | None) -> tuple[list[float], list[float]]:
    """Latitudes from north to south and longitudes from west to east over all variables."""
    rows = (axes(grid) if known is None else known).collect()  # a row per variable
    lats, lons = ({v for r in rows for v in r[c] or ()} for c in ("latitude", "longitude"))
    return sorted(lats, reverse=True), sorted(lons)


def nearest_cells(points: DataFrame, grid: DataFrame, key: str = "code", known: DataFrame | None = None) -> DataFrame:
    """The nearest cell of many points, from the small arrays of both axes (``known``: as ``axes`` gives them)."""
    out = points
    for name, values in zip(("latitude", "longitude"), _axes(grid, known), strict=True):
        choices = F.array(*(F.struct(F.abs(F.col(name) - v), F.lit(i), F.lit(float(v)).alias("at")) for i, v in enumerate(values)))
        out = out.withColumn(f"grid_{name}", F.array_min(choices)["at"])
    return out.select(key, "grid_latitude", "grid_longitude")


def crop(grid: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, buffer: tuple[int, int] = (0, 0), mode: str = REFERENCE, known: DataFrame | None = None) -> DataFrame:
    """The cells between the nearest ones to the corners, widened by ``buffer`` (longitude, latitude) cells.
    The axes come out of ``known`` (as ``axes`` gives them), or else out of one scan of the grid.

    ``reference``: without the southernmost row and the easternmost column, unless the box is one
    row or column wide; ``standard``: with both.
    """
    lats, lons = _axes(grid, known)
    if not lats or not lons:
        return grid.limit(0)
    near = lambda values, p: min(range(len(values)), key=lambda i: (abs(values[i] - p), i))
    south, north = near(lats, lat_min), near(lats, lat_max)
    west, east = near(lons, lon_min), near(lons, lon_max)
    south, north = min(south + buffer[1], len(lats) - 1), max(north - buffer[1], 0)
    west, east = max(west - buffer[0], 0), min(east + buffer[0], len(lons) - 1)
    exclusive = is_reference(mode)

    def between(name: str, values: list[float], first: int, last: int) -> Column:
        stop = last if first == last or not exclusive else last - 1
        own = values[first : stop + 1]
        return F.col(name).between(min(own), max(own)) if own else F.lit(False)

    # Plain ranges of coordinates, which reach the scan.
    return grid.where(between("latitude", lats, north, south) & between("longitude", lons, west, east))


def mosaic(grid: DataFrame, variables: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Variables side by side along longitude: each begins one degree behind the last of the one before.
    With ``known`` axes (as ``axes`` gives them) the grid isn't scanned for them."""
    rows = (axes(grid.where(F.col("variable").isin(*variables))) if known is None else known.where(F.col("variable").isin(*variables))).collect()  # a row per variable
    spans = {r["variable"]: (min(r["longitude"]), max(r["longitude"])) for r in rows if r["longitude"]}
    shift: Column = F.lit(None).cast("double")
    last = None
    for v in variables:
        if v not in spans:
            raise ValueError(f"no variable {v} in the grid")
        a, b = spans[v]
        move = 0.0 if last is None else last + 1 - a
        shift = F.when(F.col("variable") == v, F.lit(float(move))).otherwise(shift)
        last = b + move
    return grid.where(F.col("variable").isin(*variables)).withColumns({"longitude": F.col("longitude") + shift, "variable": F.lit("_".join(variables))})


def module(grid: DataFrame, keys: Sequence[str] = ("d", "latitude", "longitude")) -> DataFrame:
    """The length of the vector of all variables in each cell."""
    return grid.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))


def separate(mosaic_: DataFrame, keys: Sequence[str] = ("d", "latitude"), known: DataFrame | None = None) -> DataFrame:
    """A mosaic of two components as u, v and their module, on the longitudes of the first half.
    Longitudes need one pass, unless ``known`` (axes of the mosaic) has them; halves meet by their place, not by a self-join."""
    lons = _axes(mosaic_, known)[1]
    half = len(lons) // 2
    if not half:
        return mosaic_.limit(0).select(*keys, "longitude", F.col("value").alias("u"), F.col("value").alias("v"), F.col("value").alias("module"))
    place = {lon: (i if i < half else i - half) for i, lon in enumerate(lons)}
    target = F.create_map(*(F.lit(x) for lon, i in place.items() for x in (float(lon), float(lons[i] if i < half else lons[i]))))
    first = F.col("longitude") <= F.lit(lons[half - 1])
    halves = mosaic_.groupBy(*keys, F.try_element_at(target, F.col("longitude").cast("double")).alias("at")).agg(F.max(F.when(first, F.col("value"))).alias("u"), F.max(F.when(~first, F.col("value"))).alias("v"))
    return halves.withColumnRenamed("at", "longitude").withColumn("module", vector_module(F.col("u"), F.col("v")))


def climatology(grid: DataFrame, seasons: Sequence[Sequence[int]] = WHOLE_YEAR, period: tuple[object, object] | None = None, cell: Sequence[str] = ("latitude", "longitude"), d: str = "d") -> DataFrame:
    """Mean over ``period`` and standard deviation over all days (with n) of each season and cell."""
    x = F.col("value").cast("double")
    inside = F.col(d).between(*map(F.lit, period)) if period else F.lit(True)
    return with_season(grid, seasons, d).groupBy("season", *cell).agg(F.avg(F.when(inside, x)).alias("mean"), F.stddev_pop(x).alias("std"))


def anomalies(grid: DataFrame, seasons: Sequence[Sequence[int]] = WHOLE_YEAR, standardize: bool = False, mean_period: tuple[object, object] | None = None, base: DataFrame | None = None, cell: Sequence[str] = ("latitude", "longitude"), d: str = "d", mode: str = REFERENCE) -> DataFrame:
    """Departures from the seasonal mean (of ``base``, or of the grid itself), divided by the standard
    deviation on request; a cell that never varies has null then.

    For a test or projection grid on the mean of a training ``base`` the deviation is the grid's own in
    ``reference`` mode and the base's in ``standard`` mode. A map-side-combined aggregate joined back; no window.
    """
    own = climatology(grid, seasons, None if base is not None else mean_period, cell, d)
    if base is not None:
        other = climatology(base, seasons, mean_period, cell, d)
        own = other.join(own.select("season", *cell, F.col("std").alias("own_std")), ["season", *cell])
        own = own.withColumn("std", F.col("own_std") if is_reference(mode) else F.col("std")).drop("own_std")
    joined = with_season(grid, seasons, d).join(own, ["season", *cell])
    value = F.col("value").cast("double") - F.col("mean")
    if standardize:
        value = F.try_divide(value, F.when(F.col("std") != 0, F.col("std")))
    return joined.select("season", d, *cell, value.alias("value"))
