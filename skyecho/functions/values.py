"""Missing values, rounding and scores of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value as double, null where it is NaN or infinite."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all the columns are finite numbers, as doubles."""
    return df.withColumns({c: finite(c) for c in columns}).dropna(subset=list(columns))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


#: Aggregates by name; all skip nulls.
AGGREGATES = {
    "mean": F.avg,
    "median": F.median,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
}


def aggregate(how: str, c: Column | str, skipna: bool = True) -> Column:
    """An aggregate in which missing values are skipped (the sum of none is 0), or else make it null."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how}; there are {', '.join(AGGREGATES)}")
    x = F.col(c) if isinstance(c, str) else c
    out = AGGREGATES[how](x)
    if how == "sum":
        out = F.coalesce(out, F.lit(0.0))
    return out if skipna else F.when(F.count(F.lit(1)) == F.count(x), out)


def percentile_of_score(value: Column, by: Sequence[str | Column]) -> Column:
    """The percentile rank of each row's value among the values of its group: the mean of the
    shares below and up to it, where the value itself counts."""
    over = Window.partitionBy(*by).orderBy(value)
    below = F.rank().over(over) - 1
    up_to = F.count(value).over(over.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.count(value).over(Window.partitionBy(*by))
    return (below + up_to + F.when(below < up_to, 1).otherwise(0)) * 50.0 / total
