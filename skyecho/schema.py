"""Schemas of the long tables; readers apply them and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame


STATIONS = "code string, name string, longitude double, latitude double, altitude double"
OBSERVATIONS = "station string, ts timestamp_ntz, variable string, value double"
DAILY = "station string, d date, variable string, value double"
FIELD = "ts timestamp_ntz, latitude double, longitude double, variable string, number int, value float"
SEASONS = "season int, month int"
POOL = "season int, d date, rank int, analog_d date, distance double"
RECONSTRUCTION = "station string, d date, variable string, method string, value double, min_band double, max_band double"
SERIES = "d date, role string, model string, value double"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)} (there are: {', '.join(df.columns)})")
    return df
