"""Queries of resampling, transforms and climate indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho.functions import calendar, meteo
from skyecho.functions.values import clean_rows, finite
from skyecho.operators import indices, resample
from skyecho.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_AGG_SQL = {"mean": "avg(value)", "sum": "coalesce(sum(value), 0)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "std": "stddev_samp(value)"}


def _resample_queries() -> None:
    for how, sql in _AGG_SQL.items():

        def run(spark: SparkSession, sf_dir: str, how: str = how) -> DataFrame:
            return A.rounded(resample.resample(A.subdaily(spark, sf_dir), how, "1D", ("station",), d="ts"), ["value"])

        query(f"resample_day_{how}", f"WITH {A.SUBDAILY} SELECT station, CAST(ts AS DATE) AS period, round({sql}, 6) AS value FROM sub GROUP BY 1, 2")(run)


_resample_queries()


@query("resample_skipna_false", f"WITH {A.SUBDAILY} SELECT station, CAST(ts AS DATE) AS period, CASE WHEN count(*) = count(value) THEN round(sum(value), 6) END AS value FROM sub GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(resample.resample(A.subdaily(spark, sf_dir), "sum", "1D", ("station",), d="ts", skipna=False), ["value"])


def _period_queries() -> None:
    keys = {
        "month": ("1M", "reference", "CAST(date_trunc('month', d) AS DATE)"),
        "year": ("1Y", "reference", "CAST(date_trunc('year', d) AS DATE)"),
        "hydroyear_ref": ("1H", "reference", "CAST(year(d) - CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS BIGINT)"),
        "hydroyear_std": ("1H", "standard", "CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS BIGINT)"),
    }
    for name, (freq, mode, sql) in keys.items():

        def run(spark: SparkSession, sf_dir: str, freq: str = freq, mode: str = mode) -> DataFrame:
            out = resample.resample(A.daily_obs(spark, sf_dir), "sum", freq, values=("pcp",), mode=mode)
            return A.rounded(out.withColumn("period", F.col("period").cast("long")) if freq == "1H" else out, ["pcp"])

        query(f"resample_{name}", f"WITH {A.DAILY} SELECT {sql} AS period, round(sum(pcp), 6) AS pcp FROM daily GROUP BY 1")(run)


_period_queries()


@query("resample_all_aggregates", f"WITH {A.SUBDAILY} SELECT station, CAST(ts AS DATE) AS period, " + ", ".join(f"round({s}, 6) AS {h}" for h, s in _AGG_SQL.items()) + " FROM sub GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(resample.resample_all(A.subdaily(spark, sf_dir), list(_AGG_SQL), "1D", ("station",), d="ts"), list(_AGG_SQL))


@query("hour_filter_group", f"WITH {A.SUBDAILY} SELECT CAST(ts AS DATE) AS d, station, round(avg(value), 6) AS value FROM sub WHERE hour(ts) = 12 GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(resample.group_field(A.subdaily(spark, sf_dir), "12hour_1D_mean", ("station",)), ["value"])


_TMPA = "WITH t AS (SELECT CAST(ts AS DATE) AS d, value AS tmpa FROM events)"


@query("daily_variables_temperature", f"{_TMPA} SELECT d, round(max(tmpa), 6) AS TMAX, round(min(tmpa), 6) AS TMIN, round(avg(tmpa), 6) AS TMEAN FROM t GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.table(spark, sf_dir, "events").select("ts", F.col("value").alias("TMPA"))
    return A.rounded(resample.daily_variables(wide), ["TMAX", "TMIN", "TMEAN"])


@query("daily_variables_radiance", "WITH t AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN value * 5 >= 200 THEN value * 5 END AS r FROM events), s AS (SELECT d, coalesce(sum(r), 0) AS x FROM t GROUP BY 1) SELECT d, CASE WHEN x > 0 THEN round(x, 6) END AS RADST FROM s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.table(spark, sf_dir, "events").select("ts", (F.col("value") * 5).alias("RADS01"))
    return A.rounded(resample.daily_variables(wide), ["RADST"])


@query("daily_variables_unknown", "SELECT CAST(ts AS DATE) AS d, round(avg(value), 6) AS VALUEMEAN FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(resample.daily_variables(A.table(spark, sf_dir, "events").select("ts", "value")), ["VALUEMEAN"])


_DIRECTION = "CAST(event_id % 360 AS DOUBLE)"


@query("wind_components", f"SELECT event_id, round(cos(radians(270.0 - {_DIRECTION})) * value, 6) + 0.0 AS U, round(sin(radians(270.0 - {_DIRECTION})) * value, 6) + 0.0 AS V FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("WSPD"), (F.col("event_id") % 360).cast("double").alias("WDIR"))
    return A.rounded(meteo.wind_components(e, substitute=True), ["U", "V"])


@query("low_radiance_mask", "SELECT event_id, CASE WHEN value * 5 >= 200 THEN round(value * 5, 6) END AS value FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return A.rounded(e.select("event_id", meteo.clear_low_radiance(F.col("value") * 5).alias("value")), ["value"])


@query("relative_humidity", "WITH t AS (SELECT event_id, 270.0 + event_id % 15 AS dew, 271.0 + event_id % 25 AS air FROM events) SELECT event_id, round(100.0 * (0.611 * exp(5423.0 * (1 / 273.0::DOUBLE - 1 / dew::DOUBLE))) / (0.611 * exp(5423.0 * (1 / 273.0::DOUBLE - 1 / air::DOUBLE))), 6) AS RHMA FROM t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", (F.lit(270.0) + F.col("event_id") % 15).alias("TDEW"), (F.lit(271.0) + F.col("event_id") % 25).alias("TMPA"))
    return A.rounded(meteo.relative_humidity(e).select("event_id", "RHMA"), ["RHMA"])


@query("unit_conversion", "SELECT event_id, round(value - 273.15, 6) AS celsius, round(value * 1000, 6) AS mm FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return A.rounded(e.select("event_id", meteo.celsius(F.col("value")).alias("celsius"), meteo.millimetres(F.col("value")).alias("mm")), ["celsius", "mm"])


@query("clean_rows", "SELECT event_id, round(value, 6) AS value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return A.rounded(clean_rows(A.table(spark, sf_dir, "events").select("event_id", bad.alias("value")), ["value"]), ["value"])


@query("common_index", f"WITH {A.DAILY} SELECT a.d AS d, round(a.tmean, 6) AS value_left, round(b.tmax, 6) AS value_right FROM daily a JOIN daily b ON a.d = b.d WHERE a.tmean > 0 AND b.tmax < 30")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.daily_obs(spark, sf_dir)
    left, right = d.where("tmean > 0").select("d", F.col("tmean").alias("value")), d.where("tmax < 30").select("d", F.col("tmax").alias("value"))
    return A.rounded(resample.common_index(left, right), ["value_left", "value_right"])


@query("table_to_series", f"WITH {A.SUBDAILY}, c AS (SELECT hour(ts) AS h, month(ts) AS m, avg(value) AS value FROM sub GROUP BY 1, 2) SELECT event_id, round(c.value, 6) AS value FROM events e LEFT JOIN c ON hour(e.ts) = c.h AND month(e.ts) = c.m")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = A.subdaily(spark, sf_dir)
    clim = sub.groupBy(F.hour("ts").alias("hour"), F.month("ts").alias("month")).agg(F.avg("value").alias("value"))
    return A.rounded(resample.climatology_series(clim, A.table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", "value"), ["value"])


@query("season_label", "SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM orders GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "orders").groupBy(calendar.season_label(F.to_date("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


@query("season_assignment", f"WITH {A.DAILY}, s(season, month) AS (VALUES (0, 12), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)) SELECT CAST(s.season AS BIGINT) AS season, count(*) AS n FROM daily JOIN s ON month(d) = s.month GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.with_season(A.daily_obs(spark, sf_dir), [[12, 1, 2], [2, 3, 4]]).groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("n"))


@query("densified_days", f"WITH {A.DAILY}, r AS (SELECT min(d) AS a, max(d) AS b FROM daily), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM r) SELECT days.d AS d, round(tmean, 6) AS tmean FROM days LEFT JOIN daily ON days.d = daily.d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(calendar.densify(A.daily_obs(spark, sf_dir).select("d", "tmean"), []), ["tmean"])


@query("humidity_precip_threshold", f"WITH {A.DAILY}, w AS (SELECT tmean FROM daily WHERE pcp >= 0.25), q AS (SELECT quantile_cont(tmean, 0.25) AS q1, quantile_cont(tmean, 0.5) AS q2, quantile_cont(tmean, 0.75) AS q3 FROM w) SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower_adjacent FROM q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(resample.lower_adjacent_humidity(A.daily_obs(spark, sf_dir), "tmean", "pcp"), ["q1", "q2", "q3", "lower_adjacent"])


def _cycle_queries() -> None:
    sql = {"mean": "avg(value)", "sum": "coalesce(sum(value), 0)", "median": "median(value)", "std": "stddev_samp(value)"}
    for how, s in sql.items():

        def run(spark: SparkSession, sf_dir: str, how: str = how) -> DataFrame:
            out = resample.annual_cycle(A.models(spark, sf_dir)[1], how)
            return A.rounded(out.withColumn("month", F.col("month").cast("long")), ["value"])

        query(f"annual_cycle_{how}", f"WITH {A.MODELS} SELECT model, CAST(month(d) AS BIGINT) AS month, round({s}, 6) AS value FROM models GROUP BY 1, 2")(run)


_cycle_queries()


@query("month_year_bias_pivot", f"WITH {A.DAILY} SELECT CAST(year(d) AS BIGINT) AS year, " + ", ".join(f"round(avg(CASE WHEN month(d) = {m} THEN (tmax + tmin) / 2 - tmean END), 6) AS m{m}" for m in range(1, 13)) + " FROM daily GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.daily_obs(spark, sf_dir).select("d", ((F.col("tmax") + F.col("tmin")) / 2).alias("predicted"), F.col("tmean").alias("observed"))
    out = resample.month_year_bias(pairs)
    return A.rounded(out.withColumn("year", F.col("year").cast("long")), [f"m{m}" for m in range(1, 13)])


_MEMBERS = "m AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 5 AS VARCHAR) AS member, avg(o_totalprice) / 9.731 AS value FROM orders GROUP BY 1, 2)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 5).alias("number")).agg((F.avg("o_totalprice") / 9.731).alias("value"))


@query("ensemble_mean", f"WITH {_MEMBERS}, p AS (SELECT CAST(date_trunc('month', d) AS DATE) AS period, member, avg(value) AS value FROM m GROUP BY 1, 2) SELECT period, member, round(value, 4) AS value FROM p UNION ALL SELECT period, 'mean', round(avg(value), 4) FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(resample.ensemble(_members(spark, sf_dir), "mean", "1M"), ["value"], 4)


@query("ensemble_hydrosum", f"WITH {_MEMBERS}, p AS (SELECT CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS period, member, sum(value) AS value FROM m GROUP BY 1, 2) SELECT period, member, round(value, 2) AS value FROM p UNION ALL SELECT period, 'mean', round(avg(value), 2) FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.ensemble(_members(spark, sf_dir), "hydrosum", "1Y", mode="standard")
    return A.rounded(out.withColumn("period", F.col("period").cast("long")), ["value"], 2)


# Climate indices: of every station, so that windows are dealt by station.
_KEYS = ("station",)


def _index(name: str, sql: str, make: Callable[[DataFrame], DataFrame], value: str, float_: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(A.station_obs(spark, sf_dir))
        for c in ("year",):
            if c in out.columns:
                out = out.withColumn(c, F.col(c).cast("long"))
        return A.rounded(out, [value]) if float_ else out.withColumn(value, F.col(value).cast("long"))

    query(name, f"WITH {A.STATION}{sql}")(run)


def _flag(name: str, case: str, make: Callable[[DataFrame], DataFrame], value: str) -> None:
    _index(name, f" SELECT station, d, CAST({case} AS BIGINT) AS {value} FROM daily", make, value, float_=False)


_flag("idx_fd", "CASE WHEN tmin <= 0 THEN 1 ELSE 0 END", lambda x: indices.frost_days(x, _KEYS), "fd")
_flag("idx_fd_std", "CASE WHEN tmin < 0 THEN 1 ELSE 0 END", lambda x: indices.frost_days(x, _KEYS, "standard"), "fd")
_flag("idx_su", "CASE WHEN tmax > 25 THEN 1 ELSE 0 END", lambda x: indices.summer_days(x, _KEYS), "su")
_flag("idx_id", "CASE WHEN tmax <= 0 THEN 1 ELSE 0 END", lambda x: indices.icing_days(x, _KEYS), "id")
_flag("idx_tr", "CASE WHEN tmin > 20 THEN 1 ELSE 0 END", lambda x: indices.tropical_nights(x, _KEYS), "tr")
_flag("idx_r10mm", "CASE WHEN pcp > 9.9 THEN 1 ELSE 0 END", lambda x: indices.heavy_rain(x, 10, "r10mm", _KEYS), "r10mm")
_flag("idx_r20mm", "CASE WHEN pcp > 19.9 THEN 1 ELSE 0 END", lambda x: indices.heavy_rain(x, 20, "r20mm", _KEYS), "r20mm")
_flag("idx_rnnmm", "CASE WHEN pcp > 5 THEN 1 ELSE 0 END", lambda x: indices.rain_above(x, 5, _KEYS), "rnnmm")

_MONTH, _YEAR = "CAST(date_trunc('month', d) AS DATE)", "CAST(date_trunc('year', d) AS DATE)"
for _name, _col, _how in (("txx", "tmax", "max"), ("tnx", "tmin", "max"), ("txn", "tmax", "min"), ("tnn", "tmin", "min"), ("rx1day", "pcp", "max")):
    _index(f"idx_{_name}", f" SELECT station, {_MONTH} AS period, round({_how}({_col}), 6) AS {_name} FROM daily GROUP BY 1, 2", lambda x, c=_col, h=_how, n=_name: indices.extreme(x, c, h, n, _KEYS), _name)
_index("idx_dtr", f" SELECT station, {_MONTH} AS period, round(avg(tmax - tmin), 6) AS dtr FROM daily GROUP BY 1, 2", lambda x: indices.diurnal_range(x, _KEYS), "dtr")
_index("idx_sdii", f" SELECT station, {_MONTH} AS period, round(avg(CASE WHEN pcp >= 1 THEN pcp END), 6) AS sdii FROM daily GROUP BY 1, 2", lambda x: indices.simple_intensity(x, _KEYS), "sdii")
_index("idx_prcptot", f" SELECT station, {_YEAR} AS period, round(coalesce(sum(CASE WHEN pcp >= 1 THEN pcp END), 0), 6) AS prcptot FROM daily GROUP BY 1, 2", lambda x: indices.total_rain(x, _KEYS), "prcptot")
_index("idx_rx5day", f", s AS (SELECT station, d, sum(pcp) OVER (PARTITION BY station ORDER BY d RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW) AS s FROM daily) SELECT station, {_MONTH} AS period, round(max(s), 6) AS rx5day FROM s GROUP BY 1, 2", lambda x: indices.max_five_days(x, _KEYS), "rx5day")


def _runs(flag: str) -> str:
    return f", f AS (SELECT station, d, {flag} AS f FROM daily), c AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY station ORDER BY d) THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY d ROWS UNBOUNDED PRECEDING) AS id FROM c), r AS (SELECT *, f * row_number() OVER (PARTITION BY station, id ORDER BY d) AS run, count(*) OVER (PARTITION BY station, id) AS n FROM i)"


_index("idx_cdd", _runs("CASE WHEN pcp <= 1 THEN 1 ELSE 0 END") + f" SELECT station, {_MONTH} AS period, CAST(max(run) AS BIGINT) AS cdd FROM r GROUP BY 1, 2", lambda x: indices.dry_spell(x, _KEYS), "cdd", float_=False)
_index("idx_cwd", _runs("CASE WHEN pcp > 0.9 THEN 1 ELSE 0 END") + f" SELECT station, {_MONTH} AS period, CAST(max(run) AS BIGINT) AS cwd FROM r GROUP BY 1, 2", lambda x: indices.wet_spell(x, _KEYS), "cwd", float_=False)

# The tables begin in 1995; this stands for the base period.
_BASE = (__import__("datetime").date(1995, 1, 1), __import__("datetime").date(1998, 12, 31))
_IN_BASE = "d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"
for _name, _q in (("r95ptot", 0.95), ("r99ptot", 0.99)):
    _index(f"idx_{_name}", f", p AS (SELECT station, quantile_cont(pcp, {_q}) AS p FROM daily WHERE {_IN_BASE} GROUP BY 1) SELECT daily.station AS station, d, CAST(CASE WHEN p IS NOT NULL THEN CASE WHEN pcp > p AND pcp > 0.9 THEN 1 ELSE 0 END END AS BIGINT) AS {_name} FROM daily LEFT JOIN p ON daily.station = p.station", lambda x, q=_q, n=_name: indices.rain_over_percentile(x, q, n, _KEYS, _BASE), _name, float_=False)
    _index(f"idx_{_name}_std", f", p AS (SELECT station, quantile_cont(pcp, {_q}) AS p FROM daily WHERE {_IN_BASE} AND pcp >= 1 GROUP BY 1) SELECT daily.station AS station, {_YEAR} AS period, round(coalesce(sum(CASE WHEN pcp >= 1 AND pcp > p THEN pcp END), 0), 6) AS {_name} FROM daily LEFT JOIN p ON daily.station = p.station GROUP BY 1, 2", lambda x, q=_q, n=_name: indices.rain_over_percentile(x, q, n, _KEYS, _BASE, "standard"), _name)


def _limits(column: str, q: float, sign: str) -> str:
    return f", e AS (SELECT station, {column} AS v, strftime(d + CAST(o AS INTEGER), '%m-%d') AS day FROM daily, range(-2, 3) AS t(o) WHERE {_IN_BASE}), p AS (SELECT station, day, quantile_cont(v, {q}) AS p FROM e GROUP BY 1, 2), g AS (SELECT daily.station AS station, d, CASE WHEN {column} {sign} p THEN 1 WHEN p IS NOT NULL AND {column} IS NOT NULL THEN 0 END AS flag FROM daily LEFT JOIN p ON daily.station = p.station AND strftime(d, '%m-%d') = p.day)"


for _name, _col, _q, _above in (("tn10p", "tmin", 0.1, False), ("tx10p", "tmax", 0.1, False), ("tn90p", "tmin", 0.9, True), ("tx90p", "tmax", 0.9, True)):
    _index(f"idx_{_name}", _limits(_col, _q, ">" if _above else "<") + f" SELECT station, d, CAST(flag AS BIGINT) AS {_name} FROM g", lambda x, c=_col, q=_q, a=_above, n=_name: indices.percentile_days(x, c, q, a, n, _KEYS, _BASE), _name, float_=False)
for _name, _col, _q, _above in (("wsdi", "tmax", 0.9, True), ("csdi", "tmin", 0.1, False)):
    _index(f"idx_{_name}", _limits(_col, _q, ">" if _above else "<") + _runs("flag").replace("flag AS f FROM daily", "flag AS f FROM g") + f" SELECT station, {_YEAR} AS period, CAST(count(*) FILTER (f = 1 AND n >= 6) AS BIGINT) AS {_name} FROM r GROUP BY 1, 2", lambda x, c=_col, q=_q, a=_above, n=_name: indices.spell_duration(x, c, q, a, n, _KEYS, _BASE), _name, float_=False)


def _first(name: str, flag: str, where: str) -> str:
    return f", {name}f AS (SELECT station, year(d) AS y, d, {flag} AS f FROM daily WHERE {where}), {name}c AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY station, y ORDER BY d) THEN 0 ELSE 1 END AS new FROM {name}f), {name}i AS (SELECT *, sum(new) OVER (PARTITION BY station, y ORDER BY d ROWS UNBOUNDED PRECEDING) AS id FROM {name}c), {name}r AS (SELECT station, y, id, min(d) AS a, count(*) AS n FROM {name}i WHERE f = 1 GROUP BY 1, 2, 3), {name} AS (SELECT station, y, min(a) AS a FROM {name}r WHERE n >= 6 GROUP BY 1, 2)"


_index("idx_gsl", _first("warm", "CASE WHEN tmean > 5 THEN 1 ELSE 0 END", "TRUE") + _first("cold", "CASE WHEN tmean < 5 THEN 1 ELSE 0 END", "month(d) >= 7") + ", ys AS (SELECT DISTINCT station, year(d) AS y FROM daily) SELECT ys.station AS station, CAST(ys.y AS BIGINT) AS year, CAST(coalesce(datediff('day', warm.a, coalesce(cold.a, make_date(ys.y + 1, 1, 1))), 0) AS BIGINT) AS gsl FROM ys LEFT JOIN warm ON ys.station = warm.station AND ys.y = warm.y LEFT JOIN cold ON ys.station = cold.station AND ys.y = cold.y", lambda x: indices.growing_season(x, _KEYS), "gsl", float_=False)


@query("index_by_year", f"WITH {A.STATION} SELECT station, {_YEAR} AS period, CAST(sum(CASE WHEN tmax > 25 THEN 1 ELSE 0 END) AS BIGINT) AS su FROM daily GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = indices.summer_days(A.station_obs(spark, sf_dir), _KEYS)
    return flags.groupBy("station", calendar.period(F.col("d"), "1Y").alias("period")).agg(F.sum("su").alias("su"))


_ = finite
