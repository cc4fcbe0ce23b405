"""Seasons, periods, hydrological years and exclusion windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyecho.semantics import REFERENCE, is_reference

#: Meteorological seasons by month.
SEASON_OF_MONTH = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"}
WHOLE_YEAR: tuple[tuple[int, ...], ...] = (tuple(range(1, 13)),)


def season_label(d: Column) -> Column:
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")


def with_season(df: DataFrame, seasons: Sequence[Sequence[int]] = WHOLE_YEAR, d: str = "d", out: str = "season") -> DataFrame:
    """Each row with the place of its season; a month in several seasons gives several rows, one in none goes.

    The map has at most twelve entries and becomes an expression: no join, no shuffle.
    """
    by_month = {m: [i for i, s in enumerate(seasons) if m in s] for m in range(1, 13)}
    pairs = [x for m, own in by_month.items() if own for x in (F.lit(m), F.array(*map(F.lit, own)))]
    if not pairs:
        return df.withColumn(out, F.lit(None).cast("int")).limit(0)
    return df.withColumn(out, F.explode(F.try_element_at(F.create_map(*pairs), F.month(d))))


def hydro_year(d: Column, mode: str = REFERENCE) -> Column:
    """``standard``: October to September, named after the September; ``reference``: October to
    December count to the year before."""
    shift = -1 if is_reference(mode) else 1
    return F.year(d) + F.when(F.month(d) >= 10, shift).otherwise(0)


def period(d: Column, freq: str, mode: str = REFERENCE) -> Column:
    """The first day of the period (D, M or Y, with or without a leading 1) or the hydrological year (H, an int)."""
    unit = freq.lstrip("1").upper()
    if unit == "D":
        return d.cast("date")
    if unit in ("M", "ME"):
        return F.trunc(d, "month")
    if unit in ("Y", "YE"):
        return F.trunc(d, "year")
    if unit == "H":
        return hydro_year(d, mode)
    raise ValueError(f"unknown frequency {freq}")


def parse_grouping(spec: str | None) -> tuple[int | None, str, str]:
    """Hour (or None), frequency and aggregate of "[HHhour_]<freq>_<aggregate>"; None is noon of each day."""
    parts = (spec or "12hour_1D_mean").split("_")
    if len(parts) not in (2, 3):
        raise ValueError("a grouping has 2 or 3 parts between underscores")
    hour = int(parts[0].lower().replace("hour", "").replace("h", "")) if len(parts) == 3 else None
    return hour, parts[-2], parts[-1]


def window_reach(size: int, kind: str = "centered") -> tuple[int, int]:
    """Days before and behind a date that an exclusion window takes."""
    if size < 0:
        raise ValueError("a window can't be negative")
    if kind == "centered":
        return math.ceil(size / 2), size // 2
    if kind == "forward":
        return size, 0
    if kind in ("back", "backward"):
        return 0, size
    raise ValueError(f"unknown window type {kind}")


def densify(df: DataFrame, keys: Sequence[str], d: str = "d") -> DataFrame:
    """With a row for every day between each group's first and last, missing values where there was none."""
    span = df.groupBy(*keys).agg(F.min(d).alias("_a"), F.max(d).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(d))
    return days.join(df, [*keys, d], "left")
