"""The 27 climate indices of the WMO expert team, on long daily tables.

Daily indices give a flag per day, to be summed by month or year; the others one
value per period. ``keys`` (station and so on) partition everything; runs of days
are cut at changes of the flag only, not at the ends of months.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyecho.functions.calendar import densify, period
from skyecho.functions.meteo import flag_above
from skyecho.semantics import REFERENCE, STANDARD, is_reference

#: Millimetres of a wet day, as documented and in reference mode.
WET, WET_REFERENCE = 1.0, 0.9
BASE = (date(1961, 1, 1), date(1990, 12, 31))


def _flags(df: DataFrame, flag: Column, keys: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys, "d", flag.cast("int").alias(name))


def frost_days(df: DataFrame, keys: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    c = F.col("tmin")
    return _flags(df, flag_above(c, 0, inverse=True) if is_reference(mode) else F.when(c < 0, 1).when(c >= 0, 0), keys, "fd")


def summer_days(df: DataFrame, keys: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    return _flags(df, flag_above(F.col("tmax"), 25), keys, "su")


def icing_days(df: DataFrame, keys: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    c = F.col("tmax")
    return _flags(df, flag_above(c, 0, inverse=True) if is_reference(mode) else F.when(c < 0, 1).when(c >= 0, 0), keys, "id")


def tropical_nights(df: DataFrame, keys: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    return _flags(df, flag_above(F.col("tmin"), 20), keys, "tr")


def heavy_rain(df: DataFrame, threshold: float, name: str, keys: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    """Days of at least ``threshold`` mm; in ``reference`` mode more than 0.1 mm less for the named indices."""
    c = F.col("pcp")
    return _flags(df, flag_above(c, threshold - 0.1) if is_reference(mode) else F.when(c >= threshold, 1).when(c < threshold, 0), keys, name)


def rain_above(df: DataFrame, threshold: float, keys: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    c = F.col("pcp")
    return _flags(df, flag_above(c, threshold) if is_reference(mode) else F.when(c >= threshold, 1).when(c < threshold, 0), keys, "rnnmm")


def extreme(df: DataFrame, column: str, how: str, name: str, keys: Sequence[str] = (), freq: str = "1M") -> DataFrame:
    agg = {"max": F.max, "min": F.min}[how]
    return df.groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(agg(column).alias(name))


def runs(df: DataFrame, flag: Column, keys: Sequence[str] = (), out: str = "run") -> DataFrame:
    """With ``_id`` of the run of equal flags that each day is in and its place in it times the flag;
    a missing flag breaks runs. Days follow each other as rows do."""
    order = Window.partitionBy(*keys).orderBy("d")
    own = df.withColumn("_f", flag.cast("int"))
    new = F.when(F.col("_f").eqNullSafe(F.lag("_f").over(order)) & F.col("_f").isNotNull() & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = own.withColumn("_id", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "_id").orderBy("d"))
    return marked.withColumn(out, place * F.col("_f"))


def spell(df: DataFrame, flag: Column, name: str, keys: Sequence[str] = (), freq: str = "1M", mode: str = REFERENCE) -> DataFrame:
    """The longest run by period; ``standard`` mode lays out missing days first."""
    if not is_reference(mode):
        df = densify(df, keys)
    return runs(df, flag, keys).groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.max("run").alias(name))


def dry_spell(df: DataFrame, keys: Sequence[str] = (), mode: str = REFERENCE, freq: str = "1M") -> DataFrame:
    c = F.col("pcp")
    return spell(df, F.when(c > 1, 0).when(c <= 1, 1) if is_reference(mode) else F.when(c < 1, 1).when(c >= 1, 0), "cdd", keys, freq, mode)


def wet_spell(df: DataFrame, keys: Sequence[str] = (), mode: str = REFERENCE, freq: str = "1M") -> DataFrame:
    c = F.col("pcp")
    return spell(df, flag_above(c, WET_REFERENCE) if is_reference(mode) else F.when(c >= 1, 1).when(c < 1, 0), "cwd", keys, freq, mode)


def rain_over_percentile(df: DataFrame, q: float, name: str, keys: Sequence[str] = (), base: tuple[date, date] = BASE, mode: str = REFERENCE, freq: str = "1Y") -> DataFrame:
    """``reference``: a daily flag of more rain than the percentile of all days of the base period;
    ``standard``: the rain of days above the percentile of its wet days, by period.

    The percentile may be a day's own value, which isn't above itself. So limit and rain are one reading of the
    table (a window, no join): sums of doubles differ in the last digits where they are computed twice. Rows
    without a key have no limit; without ``keys`` the table is one window."""
    counted = F.col("d").between(*map(F.lit, base))
    if not is_reference(mode):
        counted &= F.col("pcp") >= WET
    limit = F.percentile(F.when(counted, F.col("pcp")), F.lit(q)).over(Window.partitionBy(*keys))
    for k in keys:
        limit = F.when(F.col(k).isNotNull(), limit)
    joined = df.withColumn("_p", limit)
    if is_reference(mode):
        flag = F.when(F.col("_p").isNotNull(), F.when((F.col("pcp") > F.col("_p")) & (F.col("pcp") > WET_REFERENCE), 1).otherwise(0))
        return _flags(joined, flag, keys, name)
    return joined.groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.coalesce(F.sum(F.when((F.col("pcp") >= WET) & (F.col("pcp") > F.col("_p")), F.col("pcp"))), F.lit(0.0)).alias(name))


def growing_season(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days from the first day of the first run of six days over 5 degrees to that of the first such run under
    5 degrees from July on, by calendar year; to the end of the year if there is none."""
    by_year = df.withColumn("year", F.year("d"))
    own = [*keys, "year"]
    limit = lambda flag, after: _first_run(by_year, flag, own, after)
    warm = limit(F.when(F.col("tmean") > 5, 1).when(F.col("tmean") <= 5, 0), None).withColumnRenamed("first", "warm")
    cold = limit(F.when(F.col("tmean") < 5, 1).when(F.col("tmean") >= 5, 0), 7).withColumnRenamed("first", "cold")
    years = by_year.select(*own).distinct()
    both = years.join(warm, own, "left").join(cold, own, "left")
    end = F.coalesce(F.col("cold"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)))
    return both.select(*keys, "year", F.coalesce(F.datediff(end, F.col("warm")), F.lit(0)).alias("gsl"))


def _first_run(df: DataFrame, flag: Column, keys: Sequence[str], month: int | None, length: int = 6) -> DataFrame:
    own = df.where(F.month("d") >= month) if month else df
    by_run = runs(own, flag, keys).where(F.col("_f") == 1).groupBy(*keys, "_id").agg(F.min("d").alias("first"), F.count("*").alias("n"))
    return by_run.where(F.col("n") >= length).groupBy(*keys).agg(F.min("first").alias("first"))


def calendar_percentile(df: DataFrame, column: str, q: float, keys: Sequence[str] = (), base: tuple[date, date] | None = None, window: int = 5) -> DataFrame:
    """The percentile of each calendar day (MM-dd) over the base period's days within ``window`` days around it."""
    own = df if base is None else df.where(F.col("d").between(*map(F.lit, base)))
    half = window // 2
    days = own.select(*keys, column, F.explode(F.sequence(F.date_sub("d", half), F.date_add("d", half))).alias("at"))
    return days.groupBy(*keys, F.date_format("at", "MM-dd").alias("day")).agg(F.percentile(column, F.lit(q)).alias("_p"))


def percentile_days(df: DataFrame, column: str, q: float, above: bool, name: str, keys: Sequence[str] = (), base: tuple[date, date] | None = None) -> DataFrame:
    """A flag of days beyond their calendar day's percentile (366 limits per key)."""
    limits = calendar_percentile(df, column, q, keys, base)
    joined = df.withColumn("day", F.date_format("d", "MM-dd")).join(limits, [*keys, "day"], "left")
    c = F.col(column)
    beyond = c > F.col("_p") if above else c < F.col("_p")
    return _flags(joined, F.when(beyond, 1).when(c.isNotNull() & F.col("_p").isNotNull(), 0), keys, name)


def spell_duration(df: DataFrame, column: str, q: float, above: bool, name: str, keys: Sequence[str] = (), base: tuple[date, date] | None = None, freq: str = "1Y") -> DataFrame:
    """Days by period in runs of at least six days beyond the calendar day's percentile."""
    flags = percentile_days(df, column, q, above, "_flag", keys, base)
    numbered = runs(flags, F.col("_flag"), keys)
    n = F.count("*").over(Window.partitionBy(*keys, "_id"))
    return numbered.withColumn("_n", n).groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.count_if((F.col("_f") == 1) & (F.col("_n") >= 6)).alias(name))


def diurnal_range(df: DataFrame, keys: Sequence[str] = (), freq: str = "1M") -> DataFrame:
    return df.groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.avg(F.col("tmax") - F.col("tmin")).alias("dtr"))


def max_five_days(df: DataFrame, keys: Sequence[str] = (), freq: str = "1M") -> DataFrame:
    """The largest sum of a day and the four calendar days before it."""
    day = F.unix_date("d")
    total = F.sum("pcp").over(Window.partitionBy(*keys).orderBy(day).rangeBetween(-4, 0))
    return df.withColumn("_s", total).groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.max("_s").alias("rx5day"))


def simple_intensity(df: DataFrame, keys: Sequence[str] = (), freq: str = "1M") -> DataFrame:
    return df.groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.avg(F.when(F.col("pcp") >= WET, F.col("pcp"))).alias("sdii"))


def total_rain(df: DataFrame, keys: Sequence[str] = (), freq: str = "1Y") -> DataFrame:
    return df.groupBy(*keys, period(F.col("d"), freq).alias("period")).agg(F.coalesce(F.sum(F.when(F.col("pcp") >= WET, F.col("pcp"))), F.lit(0.0)).alias("prcptot"))


class ClimateIndices:
    """Every index of a daily table with columns d and, as needed, tmin, tmax, tmean, pcp."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = (), base: tuple[date, date] = BASE) -> None:
        self.df, self.keys, self.base = df, list(keys), base

    def _need(self, *columns: str) -> DataFrame:
        missing = [c for c in columns if c not in self.df.columns]
        if missing:
            raise ValueError(f"the index needs {', '.join(missing)}")
        return self.df

    def fd(self, mode: str = REFERENCE) -> DataFrame:
        return frost_days(self._need("tmin"), self.keys, mode)

    def su(self) -> DataFrame:
        return summer_days(self._need("tmax"), self.keys)

    def id(self, mode: str = REFERENCE) -> DataFrame:
        return icing_days(self._need("tmax"), self.keys, mode)

    def tr(self) -> DataFrame:
        return tropical_nights(self._need("tmin"), self.keys)

    def gsl(self) -> DataFrame:
        return growing_season(self._need("tmean"), self.keys)

    def txx(self) -> DataFrame:
        return extreme(self._need("tmax"), "tmax", "max", "txx", self.keys)

    def tnx(self) -> DataFrame:
        return extreme(self._need("tmin"), "tmin", "max", "tnx", self.keys)

    def txn(self) -> DataFrame:
        return extreme(self._need("tmax"), "tmax", "min", "txn", self.keys)

    def tnn(self, mode: str = STANDARD) -> DataFrame:
        return extreme(self._need("tmin"), "tmin", "max" if is_reference(mode) else "min", "tnn", self.keys)

    def tn10p(self) -> DataFrame:
        return percentile_days(self._need("tmin"), "tmin", 0.1, False, "tn10p", self.keys, self.base)

    def tx10p(self) -> DataFrame:
        return percentile_days(self._need("tmax"), "tmax", 0.1, False, "tx10p", self.keys, self.base)

    def tn90p(self) -> DataFrame:
        return percentile_days(self._need("tmin"), "tmin", 0.9, True, "tn90p", self.keys, self.base)

    def tx90p(self) -> DataFrame:
        return percentile_days(self._need("tmax"), "tmax", 0.9, True, "tx90p", self.keys, self.base)

    def wsdi(self) -> DataFrame:
        return spell_duration(self._need("tmax"), "tmax", 0.9, True, "wsdi", self.keys, self.base)

    def csdi(self) -> DataFrame:
        return spell_duration(self._need("tmin"), "tmin", 0.1, False, "csdi", self.keys, self.base)

    def dtr(self) -> DataFrame:
        return diurnal_range(self._need("tmax", "tmin"), self.keys)

    def rx1day(self) -> DataFrame:
        return extreme(self._need("pcp"), "pcp", "max", "rx1day", self.keys)

    def rx5day(self) -> DataFrame:
        return max_five_days(self._need("pcp"), self.keys)

    def sdii(self) -> DataFrame:
        return simple_intensity(self._need("pcp"), self.keys)

    def r10mm(self, mode: str = REFERENCE) -> DataFrame:
        return heavy_rain(self._need("pcp"), 10, "r10mm", self.keys, mode)

    def r20mm(self, mode: str = REFERENCE) -> DataFrame:
        return heavy_rain(self._need("pcp"), 20, "r20mm", self.keys, mode)

    def rnnmm(self, threshold: float, mode: str = REFERENCE) -> DataFrame:
        return rain_above(self._need("pcp"), threshold, self.keys, mode)

    def cdd(self, mode: str = REFERENCE) -> DataFrame:
        return dry_spell(self._need("pcp"), self.keys, mode)

    def cwd(self, mode: str = REFERENCE) -> DataFrame:
        return wet_spell(self._need("pcp"), self.keys, mode)

    def r95ptot(self, mode: str = REFERENCE) -> DataFrame:
        return rain_over_percentile(self._need("pcp"), 0.95, "r95ptot", self.keys, self.base, mode)

    def r99ptot(self, mode: str = REFERENCE) -> DataFrame:
        return rain_over_percentile(self._need("pcp"), 0.99, "r99ptot", self.keys, self.base, mode)

    def prcptot(self) -> DataFrame:
        return total_rain(self._need("pcp"), self.keys)

    def all(self) -> dict[str, Callable[[], DataFrame]]:
        return {n: getattr(self, n) for n in ("fd", "su", "id", "tr", "gsl", "txx", "tnx", "txn", "tnn", "tn10p", "tx10p", "tn90p", "tx90p", "wsdi", "csdi", "dtr", "rx1day", "rx5day", "sdii", "r10mm", "r20mm", "cdd", "cwd", "r95ptot", "r99ptot", "prcptot")}
