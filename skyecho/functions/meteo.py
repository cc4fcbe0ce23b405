"""Meteorological transforms of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyecho.schema import require


def wind_components(df: DataFrame, speed: str = "WSPD", direction: str = "WDIR", substitute: bool = False) -> DataFrame:
    """U and V from speed and the direction (degrees) that the wind comes from; ``substitute`` drops both."""
    require(df, speed, direction)
    angle = F.radians(F.lit(270.0) - F.col(direction))
    out = df.withColumns({"U": F.cos(angle) * F.col(speed), "V": F.sin(angle) * F.col(speed)})
    return out.drop(speed, direction) if substitute else out


def clear_low_radiance(c: Column | str, threshold: float = 200.0) -> Column:
    """Radiance below the threshold (night) is missing."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x >= threshold, x)


def vapour_pressure(kelvin: Column) -> Column:
    """Clausius-Clapeyron, kPa."""
    return F.lit(0.611) * F.exp(F.lit(5423.0) * (F.lit(1.0 / 273.0) - F.try_divide(F.lit(1.0), kelvin)))


def relative_humidity(df: DataFrame, dew: str = "TDEW", air: str = "TMPA", out: str = "RHMA") -> DataFrame:
    """Percent, from the dew point and the air temperature in kelvin."""
    require(df, dew, air)
    return df.withColumn(out, F.lit(100.0) * F.try_divide(vapour_pressure(F.col(dew)), vapour_pressure(F.col(air))))


def celsius(kelvin: Column, offset: float = 273.15) -> Column:
    return kelvin - F.lit(offset)


def millimetres(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def vector_module(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def flag_above(c: Column, threshold: float, inverse: bool = False) -> Column:
    """1 above the threshold and 0 up to it (``inverse``: the other way round); missing stays missing."""
    yes, no = (0, 1) if inverse else (1, 0)
    return F.when(c > threshold, yes).when(c <= threshold, no)
