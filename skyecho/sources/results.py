"""Configuration, and reconstructions as stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho import schema


@dataclass
class Config:
    """What a reconstruction needs to know."""

    stations: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)
    training: tuple[date, date] | None = None
    reconstruction: tuple[date, date] | None = None
    domain: tuple[float, float, float, float] | None = None
    seasons: list[list[int]] = field(default_factory=lambda: [list(range(1, 13))])
    n_components: int = 4
    pca_scaling: int = 1
    pool_sizes: list[int] = field(default_factory=lambda: [100])
    sample_sizes: list[int] = field(default_factory=lambda: [10])
    methods: list[str] = field(default_factory=lambda: ["closest"])
    distance: str = "euclidean"
    window_size: int = 10
    window_type: str = "centered"


def read_config(text: str) -> Config:
    """A YAML or JSON document with the fields of ``Config``; unknown ones are an error."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        import json

        raw = json.loads(text)
    known = Config.__dataclass_fields__
    if unknown := set(raw) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    dates = lambda v: tuple(date(*x) if isinstance(x, list) else date.fromisoformat(str(x)) for x in v)
    return Config(**{k: dates(v) if k in ("training", "reconstruction") else tuple(v) if k == "domain" else v for k, v in raw.items()})


def open_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return read_config(f.read())


def write_reconstructions(df: DataFrame, root: str, file_format: str = "parquet") -> None:
    """By station, variable and method; ``csv`` files have a header."""
    writer = df.write.partitionBy("station", "variable", "method")
    writer.option("header", True).csv(root) if file_format == "csv" else writer.format(file_format).save(root)


def read_reconstructions(spark: SparkSession, root: str, station: str | None = None, variable: str | None = None, methods: Sequence[str] | None = None, file_format: str = "parquet") -> DataFrame:
    """Filters on the folders prune what is read."""
    reader = spark.read.schema(schema.RECONSTRUCTION)
    df = reader.option("header", True).csv(root) if file_format == "csv" else reader.format(file_format).load(root)
    for name, value in (("station", station), ("variable", variable)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.where(F.col("method").isin(*methods)) if methods else df


def members(df: DataFrame, column: str = "number") -> dict[object, DataFrame]:
    """A lazily filtered table per ensemble member."""
    return {r[0]: df.where(F.col(column).eqNullSafe(r[0])) for r in df.select(column).distinct().orderBy(column).collect()}
