"""Aggregation in time: daily variables, periods, climatologies, ensembles, biases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyecho.functions.calendar import hydro_year, parse_grouping, period
from skyecho.functions.meteo import clear_low_radiance
from skyecho.functions.values import aggregate, clean_rows, finite
from skyecho.semantics import REFERENCE, is_reference


def resample(df: DataFrame, how: str, freq: str = "1D", keys: Sequence[str] = (), values: Sequence[str] = ("value",), d: str = "d", skipna: bool = True, mode: str = REFERENCE, out: str = "period") -> DataFrame:
    """Aggregates the values by period (and keys). Periods without a row don't appear."""
    return df.groupBy(*keys, period(F.col(d), freq, mode).alias(out)).agg(*(aggregate(how, finite(v), skipna).alias(v) for v in values))


def resample_all(df: DataFrame, hows: Sequence[str], freq: str = "1D", keys: Sequence[str] = (), value: str = "value", d: str = "d", skipna: bool = True) -> DataFrame:
    """Several aggregates of one value in a single pass."""
    return df.groupBy(*keys, period(F.col(d), freq).alias("period")).agg(*(aggregate(h, finite(value), skipna).alias(h) for h in hows))


#: Variables in order of precedence, with the daily columns made of each.
DAILY_RULES = {
    "TMAX": (("TMAX", "max"),),
    "TMIN": (("TMIN", "min"),),
    "TMEAN": (("TMEAN", "mean"),),
    "TMPA": (("TMAX", "max"), ("TMIN", "min"), ("TMEAN", "mean")),
    "WSPD": (("VMEAN", "mean"),),
    "RADS01": (("RADST", "sum"),),
    "PCP": (("PCP", "sum"),),
    "RHMA": (("RHMAX", "max"), ("RHMEAN", "mean")),
}


def daily_variables(df: DataFrame, ts: str = "ts", keys: Sequence[str] = (), skipna: bool = True, grouping: str = "mean", mode: str = REFERENCE) -> DataFrame:
    """Daily columns out of a wide sub-daily table. In ``reference`` mode only the first known variable
    counts, in ``standard`` mode all do; unknown ones become <NAME><GROUPING> if there is no known one."""
    known = [v for v in DAILY_RULES if v in df.columns]
    if known and is_reference(mode):
        known = known[:1]
    outputs: dict[str, Column] = {}
    for v in known:
        x = finite(v)
        if v == "RADS01":
            x = clear_low_radiance(x)
        for name, how in DAILY_RULES[v]:
            made = aggregate(how, x, skipna)
            outputs.setdefault(name, F.when(made > 0, made) if name == "RADST" else made)
    if not known:
        for v in df.columns:
            if v not in (ts, *keys):
                outputs[v.upper() + grouping.upper()] = aggregate(grouping, finite(v), skipna)
    return df.groupBy(*keys, F.to_date(ts).alias("d")).agg(*(c.alias(n) for n, c in outputs.items()))


def group_field(df: DataFrame, grouping: str | None = None, keys: Sequence[str] = ("latitude", "longitude", "variable"), ts: str = "ts", value: str = "value") -> DataFrame:
    """A gridded table by period and cell, of one hour if the grouping names one. Filters on
    keys made later reach the scan, so cropping after this costs nothing."""
    hour, freq, how = parse_grouping(grouping)
    if hour is not None:
        df = df.where(F.hour(ts) == hour)
    return df.groupBy(period(F.col(ts), freq).alias("d"), *keys).agg(aggregate(how, finite(value)).alias(value))


def climatology_series(table: DataFrame, index: DataFrame, ts: str = "ts") -> DataFrame:
    """An (hour, month) table laid out over the times of ``index``."""
    keyed = index.withColumns({"hour": F.hour(ts), "month": F.month(ts)})
    # 24 x 12 keys at most
    return keyed.join(F.broadcast(table.dropDuplicates(["hour", "month"])), ["hour", "month"], "left")


def common_index(left: DataFrame, right: DataFrame, on: str = "d", columns: Sequence[str] = ("value",), clean: bool = True) -> DataFrame:
    """Rows of both with the same index, as <column>_left and <column>_right."""
    if clean:
        left, right = clean_rows(left, columns), clean_rows(right, columns)
    l = left.select(on, *(F.col(c).alias(f"{c}_left") for c in columns))  # noqa: E741
    return l.join(right.select(on, *(F.col(c).alias(f"{c}_right") for c in columns)), on)


def ensemble(df: DataFrame, how: str, freq: str = "1M", member: str = "number", value: str = "value", d: str = "d", mode: str = REFERENCE) -> DataFrame:
    """Each member by period and, as member ``mean``, the mean over members. ``hydrosum`` with yearly
    periods sums hydrological years."""
    hydro = how == "hydrosum" and freq.upper().endswith("Y")
    key = hydro_year(F.col(d), mode) if hydro else period(F.col(d), freq)
    by_member = df.groupBy(key.alias("period"), F.col(member).cast("string").alias("member")).agg(aggregate("sum" if how == "hydrosum" else how, finite(value)).alias("value"))
    # One further aggregation of the small result, not a second pass over the data.
    sets = by_member.rollup("period", "member").agg(F.avg("value").alias("value"), F.grouping_id().alias("g"))
    return sets.where("g < 2").select("period", F.when(F.col("g") == 1, "mean").otherwise(F.col("member")).alias("member"), "value")


def annual_cycle(df: DataFrame, how: str = "mean", keys: Sequence[str] = ("model",), value: str = "value", d: str = "d") -> DataFrame:
    return df.groupBy(*keys, F.month(d).alias("month")).agg(aggregate(how, finite(value)).alias("value"))


def month_year_bias(pairs: DataFrame, predicted: str = "predicted", observed: str = "observed", d: str = "d", keys: Sequence[str] = ()) -> DataFrame:
    """The mean of predicted less observed by year (rows) and month (columns m1 to m12)."""
    diff = pairs.withColumns({"year": F.year(d), "month": F.month(d), "diff": finite(predicted) - finite(observed)})
    wide = diff.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.avg("diff"))
    return wide.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def largest_bias(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The largest absolute value of a table of ``month_year_bias``, by which its colours are scaled."""
    most = F.greatest(*(F.max(F.abs(F.col(f"m{m}"))) for m in range(1, 13)))
    return table.groupBy(*keys).agg(most.alias("bias_max"))


def reconstruction_ensemble(df: DataFrame, how: str, freq: str = "1M", keys: Sequence[str] = ("variable", "method"), d: str = "d", skipna: bool = True, mode: str = REFERENCE) -> DataFrame:
    """Reconstructions of many methods (long: ``keys``, d, value and bands) by period, as ``period, model, value``, a model being
    <variable>_<method>. Bands are left out. ``hydrosum`` with yearly periods sums hydrological years."""
    hydro = how == "hydrosum" and freq.upper().endswith("Y")
    plain = "sum" if how == "hydrosum" else how
    if plain not in ("mean", "sum"):
        raise ValueError(f"grouping {how} does not exist")
    key = hydro_year(F.col(d), mode) if hydro else period(F.col(d), freq)
    return df.groupBy(key.alias("period"), F.concat_ws("_", *keys).alias("model")).agg(aggregate(plain, finite("value"), skipna).alias("value"))


def selected(df: DataFrame, labels: Sequence[str] | None = None, name: str = "model", d: str = "d") -> DataFrame:
    """Rows of the given labels (None: all) with ``month`` and ``year`` beside them."""
    out = df if labels is None else df.where(F.col(name).isin(*labels))
    return out.withColumns({"month": F.month(d), "year": F.year(d)})


def melted(wide: DataFrame, ids: Sequence[str], name: str = "model", value: str = "value") -> DataFrame:
    """A wide table, a column per series, in long form."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], name, value)


def renamed(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Every column whose name contains a key of ``parts`` gets its value as name; the first key that fits decides, and two
    columns with one new name are an error."""
    new = [next((to for part, to in parts.items() if part in c), c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"several columns would have one name: {', '.join(sorted({n for n in new if new.count(n) > 1}))}")
    return df.toDF(*new)


def lower_adjacent_humidity(df: DataFrame, humidity: str = "humidity", precipitation: str = "precipitation", threshold: float = 0.25) -> DataFrame:
    """Quartiles of the humidity of rainy days and the lower adjacent value: the first quartile less 1.5 ranges."""
    wet = df.where(F.col(precipitation) >= threshold).agg(F.percentile(humidity, F.lit(0.25)).alias("q1"), F.percentile(humidity, F.lit(0.5)).alias("q2"), F.percentile(humidity, F.lit(0.75)).alias("q3"))
    return wet.withColumn("lower_adjacent", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
