"""Queries of the analog search, the grid and verification."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho.operators import analogs, grid, resample, skill
from skyecho.operators.predictor import Predictor
from skyecho.plans import adapters as A
from skyecho.plans.queries_time import query

K = 10


def pool(spark: SparkSession, sf_dir: str, vw_type: str = "centered", vw_size: int = 10, size: int = K, distance: str = "euclidean") -> DataFrame:
    """Pools of every day of the space."""
    pcs = A.pc_space(spark, sf_dir)
    return analogs.analog_pool(pcs, A.pc_observed(spark, sf_dir).select("d"), pcs.select("d"), size, vw_size, vw_type, distance)


def _ranked_sql(before: int, behind: int, size: int = K, by: str = "", measure: str = "list_distance(t.pc, c.pc)", names: str = "pairs", source: str = "space") -> str:
    """CTEs t, pairs, ranked and pool out of ``space`` and candidates c (space rows, with ``by`` if given); every day is a target."""
    own, key = (f"c.{by} AS {by}, ", f"{by}, ") if by else ("", "")
    return f"""t AS (SELECT * FROM {source}),
        {names} AS (SELECT {own}t.season AS season, t.d AS d, c.d AS analog_d, {measure} AS distance FROM t JOIN c ON t.season = c.season
            WHERE c.d <> t.d AND NOT (datediff('day', t.d, c.d) BETWEEN -{before} AND {behind})),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}season, d ORDER BY distance, analog_d) - 1 AS rank FROM {names}),
        pool AS (SELECT * FROM ranked WHERE rank < {size})"""


def _pool_sql(before: int, behind: int, size: int = K) -> str:
    return f"{A.PC}, {A.PC_OBSERVED}, c AS (SELECT * FROM space WHERE d IN (SELECT d FROM long)), {_ranked_sql(before, behind, size)}"


_POOL_OUT = "SELECT CAST(season AS BIGINT) AS season, d, CAST(rank AS BIGINT) AS rank, analog_d, round(distance, 6) AS distance FROM pool"


def _shown(df: DataFrame) -> DataFrame:
    return A.rounded(df.withColumns({"season": F.col("season").cast("long"), "rank": F.col("rank").cast("long")}), ["distance"])


for _kind, _size, _reach in (("centered", 10, (5, 5)), ("centered", 3, (2, 1)), ("forward", 4, (4, 0)), ("back", 4, (0, 4))):
    query(f"knn_window_{_kind}_{_size}", f"WITH {_pool_sql(*_reach)} {_POOL_OUT}")(lambda spark, sf_dir, k=_kind, s=_size: _shown(pool(spark, sf_dir, k, s)))
query("knn_euclidean", f"WITH {_pool_sql(0, 0)} {_POOL_OUT}")(lambda spark, sf_dir: _shown(pool(spark, sf_dir, vw_size=0)))


def _mahalanobis_sql() -> str:
    """The squared form by the factors L and D of each season's 4 x 4 covariance: sums of z^2 / D with L z = x."""
    cov = ", ".join(f"covar_samp(pc[{i}], pc[{j}]) AS c{i}{j}" for i in range(1, 5) for j in range(i, 5))
    steps = f"""cov AS (SELECT season, {cov} FROM space GROUP BY 1),
        f1 AS (SELECT *, c12 / c11 AS l21, c13 / c11 AS l31, c14 / c11 AS l41 FROM cov),
        f2 AS (SELECT *, c22 - l21 * l21 * c11 AS d2 FROM f1),
        f3 AS (SELECT *, (c23 - l31 * l21 * c11) / d2 AS l32, (c24 - l41 * l21 * c11) / d2 AS l42 FROM f2),
        f4 AS (SELECT *, c33 - l31 * l31 * c11 - l32 * l32 * d2 AS d3 FROM f3),
        f5 AS (SELECT *, (c34 - l41 * l31 * c11 - l42 * l32 * d2) / d3 AS l43 FROM f4),
        f6 AS (SELECT *, c44 - l41 * l41 * c11 - l42 * l42 * d2 - l43 * l43 * d3 AS d4 FROM f5),
        z AS (SELECT s.season AS season, s.d AS d, pc[1] AS z1, pc[2] - l21 * pc[1] AS z2, pc, c11, d2, d3, d4, l31, l32, l41, l42, l43 FROM space s JOIN f6 ON s.season = f6.season),
        y AS (SELECT *, pc[3] - l31 * z1 - l32 * z2 AS z3 FROM z),
        w AS (SELECT season, d, [z1 / sqrt(c11), z2 / sqrt(d2), z3 / sqrt(d3), (pc[4] - l41 * z1 - l42 * z2 - l43 * z3) / sqrt(d4)] AS pc FROM y),
        c AS (SELECT * FROM w WHERE d IN (SELECT d FROM long))"""
    return f"WITH {A.PC}, {A.PC_OBSERVED}, {steps}, {_ranked_sql(5, 5, source='w')} {_POOL_OUT}"


@query("knn_mahalanobis", _mahalanobis_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcs = A.pc_space(spark, sf_dir, 4)
    return _shown(analogs.analog_pool(pcs, A.pc_observed(spark, sf_dir).select("d"), pcs.select("d"), K, distance="mahalanobis"))


def _recon_out(df: DataFrame) -> DataFrame:
    out = df.select(F.col("season").cast("long").alias("season"), "d", "variable", "method", "value", "min_band", "max_band")
    return A.rounded(out, ["value", "min_band", "max_band"])


_OWN = "own AS (SELECT pool.*, long.variable AS variable, long.value AS value FROM pool JOIN long ON pool.analog_d = long.d)"
_HEAD = "SELECT CAST(season AS BIGINT) AS season, d, variable"
_CLOSEST = f"{_HEAD}, 'closest' AS method, round(arg_min(value, rank), 6) AS value, round(min(value), 6) AS min_band, round(max(value), 6) AS max_band FROM own"
_AVERAGE = f"{_HEAD}, 'average{{m}}' AS method, CASE WHEN min(distance) <> 0 THEN round(sum(value / nullif(distance * distance, 0)) / sum(1 / nullif(distance * distance, 0)), 6) END AS value, round(min(value), 6) AS min_band, round(max(value), 6) AS max_band FROM own WHERE rank < {{m}}"
_QUANTILE = """own_map AS (SELECT own.*, a.value AS own_map, b.value AS map FROM own JOIN mapping a ON own.d = a.d LEFT JOIN mapping b ON own.analog_d = b.d),
    scored AS (SELECT *, rank() OVER w - 1 AS below, count(value) OVER (PARTITION BY season, d, variable ORDER BY value RANGE UNBOUNDED PRECEDING) AS upto, count(value) OVER g AS n,
        sum(CASE WHEN map < own_map THEN 1 ELSE 0 END) OVER g AS mb, sum(CASE WHEN map <= own_map THEN 1 ELSE 0 END) OVER g + 1 AS mu, count(map) OVER g + 1 AS mn FROM own_map
        WINDOW w AS (PARTITION BY season, d, variable ORDER BY value), g AS (PARTITION BY season, d, variable)),
    away AS (SELECT *, round(abs((below + upto + CASE WHEN below < upto THEN 1 ELSE 0 END) * 50.0::DOUBLE / n - (mb + mu + 1) * 50.0::DOUBLE / mn), 9) AS away FROM scored),
    best AS (SELECT *, row_number() OVER (PARTITION BY season, d, variable ORDER BY away, rank) AS pick FROM away)"""
_QUANTILE_OUT = f"{_HEAD}, 'quantilemap' AS method, round(max(value) FILTER (pick = 1), 6) AS value, round(min(value), 6) AS min_band, round(max(value), 6) AS max_band FROM best"
_BY = " GROUP BY season, d, variable"


_POOLED = f"WITH {_pool_sql(5, 5)}, {_OWN}"


@query("recon_closest", f"{_POOLED} {_CLOSEST}{_BY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon_out(analogs.reconstruct(pool(spark, sf_dir), A.pc_observed(spark, sf_dir)))


@query("recon_average", f"{_POOLED} {_AVERAGE.format(m=5)}{_BY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon_out(analogs.reconstruct(pool(spark, sf_dir), A.pc_observed(spark, sf_dir), "average", 5))


@query("recon_quantilemap", f"{_POOLED}, {A.PC_MAPPING}, {_QUANTILE} {_QUANTILE_OUT}{_BY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon_out(analogs.reconstruct(pool(spark, sf_dir), A.pc_observed(spark, sf_dir), "quantilemap", mapping=A.pc_mapping(spark, sf_dir)))


@query("recon_sweep", f"{_POOLED}, {A.PC_MAPPING}, {_QUANTILE} {_CLOSEST}{_BY} UNION ALL {_AVERAGE.format(m=2)}{_BY} UNION ALL {_AVERAGE.format(m=5)}{_BY} UNION ALL {_QUANTILE_OUT.replace('quantilemap', f'quantilemap{K}')}{_BY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon_out(analogs.sweep(pool(spark, sf_dir), A.pc_observed(spark, sf_dir), [K], [2, 5], A.pc_mapping(spark, sf_dir)))


_GAPS = f"{A.PC}, {A.PC_GAPS}"
_GAPS_OWN = "own AS (SELECT pool.*, long.variable AS variable, long.value AS value FROM pool JOIN long ON pool.analog_d = long.d{on})"


@query("recon_multivariable", f"WITH {_GAPS}, c AS (SELECT * FROM space WHERE d IN (SELECT d FROM long GROUP BY d HAVING count(value) = 2)), {_ranked_sql(5, 5)}, {_GAPS_OWN.format(on='')} {_CLOSEST}{_BY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcs = A.pc_space(spark, sf_dir)
    return _recon_out(analogs.Analogs(pcs, A.pc_gaps(spark, sf_dir), pcs.select("d")).reconstruct(K))


@query("recon_multivariable_std", f"WITH {_GAPS}, c AS (SELECT space.*, variable FROM space JOIN long ON space.d = long.d WHERE value IS NOT NULL), {_ranked_sql(5, 5, by='variable')}, {_GAPS_OWN.format(on=' AND pool.variable = long.variable').replace('pool.*', 'pool.* EXCLUDE (variable)')} {_CLOSEST}{_BY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcs = A.pc_space(spark, sf_dir)
    return _recon_out(analogs.Analogs(pcs, A.pc_gaps(spark, sf_dir), pcs.select("d")).reconstruct(K, mode="standard"))


_STATIONS_OWN = "own AS (SELECT pool.*, s.variable AS variable, s.value AS value FROM pool JOIN s ON pool.analog_d = s.d AND pool.station = s.station)"
_BY_STATION = [x.replace("CAST(season", "station, CAST(season") + " GROUP BY station, season, d, variable" for x in (_CLOSEST, _AVERAGE.format(m=3))]


@query("recon_all_stations", f"WITH {_GAPS}, s AS (SELECT station, d, variable, value FROM long, (VALUES ('east', 2), ('west', 5)) AS x(station, k) WHERE datediff('day', DATE '2000-01-01', d) % k <> 0), c AS (SELECT space.*, station FROM space JOIN (SELECT station, d FROM s GROUP BY 1, 2 HAVING count(value) = 2) q ON space.d = q.d), {_ranked_sql(5, 5, by='station')}, {_STATIONS_OWN} {' UNION ALL '.join(_BY_STATION)}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcs = A.pc_space(spark, sf_dir)
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("station"), F.lit(k).alias("k")) for n, k in (("east", 2), ("west", 5)))))
    observed = A.pc_gaps(spark, sf_dir).withColumn("x", every).where(F.datediff("d", F.lit("2000-01-01")) % F.col("x.k") != 0).select("x.station", "d", "variable", "value")
    out = analogs.reconstruct_all(pcs, observed, pcs.select("d"), [K], [3])
    return A.rounded(out.select("station", F.col("season").cast("long").alias("season"), "d", "variable", "method", "value", "min_band", "max_band"), ["value", "min_band", "max_band"])


@query("nearest_gridpoint", "WITH lat AS (SELECT DISTINCT round(s_acctbal / 100) AS v FROM supplier), lon AS (SELECT DISTINCT CAST(s_nationkey AS DOUBLE) AS v FROM supplier), a AS (SELECT v, row_number() OVER (ORDER BY v DESC) - 1 AS i FROM lat), b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM lon) SELECT (SELECT i FROM a ORDER BY abs(v - 40.8), i LIMIT 1) AS ilat, (SELECT v FROM a ORDER BY abs(v - 40.8), i LIMIT 1) AS latitude, (SELECT i FROM b ORDER BY abs(v - 3.9), i LIMIT 1) AS ilon, (SELECT v FROM b ORDER BY abs(v - 3.9), i LIMIT 1) AS longitude")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.table(spark, sf_dir, "supplier").select(F.round(F.col("s_acctbal") / 100).alias("latitude"), F.col("s_nationkey").cast("double").alias("longitude"))
    return grid.nearest_gridpoint(g, 40.8, 3.9).withColumns({"ilat": F.col("ilat").cast("long"), "ilon": F.col("ilon").cast("long")})


@query("nearest_cells", "WITH lat(v) AS (VALUES (50.0::DOUBLE), (40.0), (30.0)), lon(v) AS (VALUES (-10.0::DOUBLE), (-5.0)) SELECT s_suppkey AS code, (SELECT arg_min(v, (abs(v - (20 + s_suppkey % 40)), -v)) FROM lat) AS grid_latitude, (SELECT arg_min(v, (abs(v - (-(s_suppkey % 13))), v)) FROM lon) AS grid_longitude FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), (20 + F.col("s_suppkey") % 40).cast("double").alias("latitude"), (-(F.col("s_suppkey") % 13)).cast("double").alias("longitude"))
    return grid.nearest_cells(points, A.field(spark, sf_dir))


_FIELD_OUT = "SELECT d, latitude, longitude, variable, round(value, 6) AS value FROM field"


@query("crop_domain", f"WITH {A.FIELD} {_FIELD_OUT} WHERE latitude BETWEEN 40 AND 50 AND longitude = -10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(grid.crop(A.field(spark, sf_dir), 29, 51, -11, -4), ["value"])


@query("crop_domain_std", f"WITH {A.FIELD} {_FIELD_OUT} WHERE latitude BETWEEN 30 AND 40")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(grid.crop(A.field(spark, sf_dir), 29, 41, -11, -4, mode="standard"), ["value"])


@query("mosaic", f"WITH {A.FIELD} SELECT d, latitude, CASE variable WHEN 'q' THEN longitude ELSE longitude + 6 END AS longitude, 'q_r' AS variable, round(value, 6) AS value FROM field")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(grid.mosaic(A.field(spark, sf_dir), ["q", "r"]), ["value"])


@query("vector_module", f"WITH {A.FIELD} SELECT d, latitude, longitude, round(sqrt(sum(value * value)), 6) AS value FROM field GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(grid.module(A.field(spark, sf_dir)), ["value"])


@query("separate_components", f"WITH {A.FIELD} SELECT d, latitude, longitude, round(max(CASE WHEN variable = 'q' THEN value END), 6) AS u, round(max(CASE WHEN variable = 'r' THEN value END), 6) AS v, round(sqrt(sum(value * value)), 6) AS module FROM field GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(grid.separate(grid.mosaic(A.field(spark, sf_dir), ["q", "r"])), ["u", "v", "module"])


_SEASONS = [[12, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
_SEASON = "CASE WHEN month(d) IN (12, 1, 2) THEN 0 WHEN month(d) <= 5 THEN 1 WHEN month(d) <= 8 THEN 2 ELSE 3 END"
_SPAN = "d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"
_PERIOD = (date(1995, 1, 1), date(1998, 12, 31))
_Q = f"{A.FIELD}, g AS (SELECT {_SEASON} AS season, d, latitude, longitude, value FROM field WHERE variable = 'q'), clim AS (SELECT season, latitude, longitude, avg(value) FILTER ({_SPAN}) AS mean, stddev_pop(value) AS std FROM g GROUP BY 1, 2, 3)"
_ANOMALY = "SELECT CAST(g.season AS BIGINT) AS season, d, g.latitude AS latitude, g.longitude AS longitude, {v} AS value FROM g JOIN clim ON g.season = clim.season AND g.latitude = clim.latitude AND g.longitude = clim.longitude"


def _quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.field(spark, sf_dir).where("variable = 'q'").drop("variable")


def _season_long(df: DataFrame, *columns: str) -> DataFrame:
    return A.rounded(df.withColumn("season", F.col("season").cast("long")), columns)


@query("seasonal_climatology", f"WITH {_Q} SELECT CAST(season AS BIGINT) AS season, latitude, longitude, round(mean, 6) AS mean, round(std, 6) AS std FROM clim")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season_long(grid.climatology(_quantity(spark, sf_dir), _SEASONS, _PERIOD), "mean", "std")


@query("seasonal_anomalies", f"WITH {_Q} {_ANOMALY.format(v='round(value - mean, 6)')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season_long(grid.anomalies(_quantity(spark, sf_dir), _SEASONS, mean_period=_PERIOD), "value")


@query("standardized_anomalies", f"WITH {_Q} {_ANOMALY.format(v='round((value - mean) / nullif(std, 0), 6)')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season_long(grid.anomalies(_quantity(spark, sf_dir), _SEASONS, True, _PERIOD), "value")


def _projection(mode: str) -> None:
    own = "o.std" if mode == "reference" else "b.std"
    sql = f"WITH {A.FIELD}, a AS (SELECT {_SEASON} AS season, d, latitude, longitude, value FROM field WHERE variable = 'q'), b AS (SELECT season, latitude, longitude, avg(value) AS mean, stddev_pop(value) AS std FROM a WHERE {_SPAN} GROUP BY 1, 2, 3), p AS (SELECT * FROM a WHERE NOT ({_SPAN})), o AS (SELECT season, latitude, longitude, stddev_pop(value) AS std FROM p GROUP BY 1, 2, 3) SELECT CAST(p.season AS BIGINT) AS season, d, p.latitude AS latitude, p.longitude AS longitude, round((value - b.mean) / nullif({own}, 0), 6) AS value FROM p JOIN b ON p.season = b.season AND p.latitude = b.latitude AND p.longitude = b.longitude JOIN o ON p.season = o.season AND p.latitude = o.latitude AND p.longitude = o.longitude"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = _quantity(spark, sf_dir)
        inside = F.col("d").between(*map(F.lit, _PERIOD))
        return _season_long(grid.anomalies(q.where(~inside), _SEASONS, True, base=q.where(inside), mode=mode), "value")

    query(f"projection_anomalies_{'ref' if mode == 'reference' else 'std'}", sql)(run)


_projection("reference")
_projection("standard")


def predictor(spark: SparkSession, sf_dir: str) -> Predictor:
    """The quantity field by seasons."""
    return Predictor(_quantity(spark, sf_dir), _SEASONS)


for _scaling, _name in ((0, "pca_pcs_raw"), (1, "pca_pcs"), (2, "pca_pcs_times")):
    query(_name)(lambda spark, sf_dir, k=_scaling: predictor(spark, sf_dir).pcs(4, k))


@query("pca_modes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictor(spark, sf_dir).fit(4).drop("loading")


@query("pca_projection")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quantity(spark, sf_dir)
    inside = F.col("d").between(*map(F.lit, _PERIOD))
    return Predictor(q, _SEASONS).pcs(4, training=_PERIOD, project=q.where(~inside))


@query("recon_full_pipeline")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field, anomalies, components, pool, three methods, skill of each."""
    pcs = predictor(spark, sf_dir).pcs()
    observed = A.daily_obs(spark, sf_dir).select("d", F.lit("tmean").alias("variable"), F.col("tmean").alias("value"))
    mapping = A.daily_obs(spark, sf_dir).select("d", F.col("tmax").alias("value"))
    found = analogs.Analogs(pcs, observed, pcs.select("d").distinct())
    made = analogs.sweep(found.get_pool(20), observed, [20], [5], mapping)
    return skill.skill_table(observed, made.select("d", F.col("method").alias("model"), "value"), threshold=10.0)


_JOINED = f"{A.MODELS}, p AS (SELECT m.model AS model, m.d AS d, o.value AS obs, m.value AS sim, r.value AS ref FROM models m LEFT JOIN obs o ON m.d = o.d LEFT JOIN (SELECT * FROM models WHERE model = 'mid') r ON m.d = r.d)"
_SKILLS = {
    "bias": "avg(obs - sim)",
    "rmse": "sqrt(avg((obs - sim) ** 2))",
    "r": "corr(obs, sim)",
    "r2": "corr(obs, sim)",
    "std": "stddev_pop(sim)",
}
_HIT = "CASE WHEN {c} >= 10 THEN 1.0 WHEN {c} < 10 THEN 0.0 END"
_BS = f"avg(({_HIT.format(c='sim')} - {_HIT.format(c='obs')}) ** 2)"


def _skills(spark: SparkSession, sf_dir: str, **k: object) -> DataFrame:
    out = skill.skill_table(*A.models(spark, sf_dir), **k)
    return A.rounded(out, [c for c in out.columns if c != "model"])


@query("skill_table", f"WITH {_JOINED} SELECT model, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in _SKILLS.items()) + f", round({_BS}, 6) AS bs FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skills(spark, sf_dir, threshold=10.0)


_SSMSE = "round(1 - avg((obs - sim) ** 2) / nullif(avg((obs - ref) ** 2), 0), 6) AS ssmse"
_BOTH = "obs IS NOT NULL AND {c} IS NOT NULL"


def _acc(c: str) -> str:
    both = _BOTH.format(c=c)
    return f"(count(*) FILTER ({both} AND (obs >= 10) = ({c} >= 10)))::DOUBLE / count(*) FILTER ({both})"


@query("skill_ssmse", f"WITH {_JOINED} SELECT model, {_SSMSE} FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skills(spark, sf_dir, reference="mid").select("model", "ssmse")


@query("skill_hss", f"WITH {_JOINED}, a AS (SELECT model, {_acc('sim')} AS r, {_acc('ref')} AS r0 FROM p GROUP BY 1) SELECT model, round(CASE WHEN r0 = 1 THEN 9999 ELSE (r - r0) / nullif(1 - r0, 0) END, 6) AS hss FROM a")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skills(spark, sf_dir, reference="mid", threshold=10.0).select("model", "hss")


_CELLS_SQL = f"{_JOINED}, t AS (SELECT model, count(*) FILTER (obs >= 10 AND sim >= 10) AS tp, count(*) FILTER (obs < 10 AND sim < 10) AS tn, count(*) FILTER (obs < 10 AND sim >= 10) AS fp, count(*) FILTER (obs >= 10 AND sim < 10) AS fn FROM p GROUP BY 1)"


@query("skill_hss_std", f"WITH {_CELLS_SQL} SELECT model, round(2.0 * (tp * tn - fp * fn) / nullif(((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))::DOUBLE, 0), 6) AS hss FROM t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = skill.paired(*A.models(spark, sf_dir))
    return A.rounded(pairs.groupBy("model").agg(skill.hss(F.col("obs"), F.col("sim"), None, 10.0, "standard").alias("hss")), ["hss"])


@query("reference_std", f"WITH {A.MODELS} SELECT round(stddev_samp(value), 6) AS std_ref FROM obs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(skill.reference_std(A.models(spark, sf_dir)[0]), ["std_ref"])


@query("reconstruction_ensemble", f"WITH {A.MODELS} SELECT CAST(date_trunc('month', d) AS DATE) AS period, 'tmean_' || model AS model, round(avg(value), 6) AS value FROM models GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.models(spark, sf_dir)[1].select("d", F.lit("tmean").alias("variable"), F.col("model").alias("method"), "value", F.lit(0.0).alias("min_band"), F.lit(0.0).alias("max_band"))
    return A.rounded(resample.reconstruction_ensemble(made, "mean", "1M"), ["value"])


@query("reconstruction_ensemble_hydrosum", f"WITH {A.MODELS} SELECT CAST(year(d) - CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS period, 'tmean_' || model AS model, round(sum(value), 4) AS value FROM models GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.models(spark, sf_dir)[1].select("d", F.lit("tmean").alias("variable"), F.col("model").alias("method"), "value")
    out = resample.reconstruction_ensemble(made, "hydrosum", "1Y")
    return A.rounded(out.withColumn("period", F.col("period").cast("long")), ["value"], 4)


@query("largest_month_bias", f"WITH {A.DAILY}, b AS (SELECT year(d), month(d), avg((tmax + tmin) / 2 - tmean) AS v FROM daily GROUP BY 1, 2) SELECT round(max(abs(v)), 6) AS bias_max FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.daily_obs(spark, sf_dir).select("d", ((F.col("tmax") + F.col("tmin")) / 2).alias("predicted"), F.col("tmean").alias("observed"))
    return A.rounded(resample.largest_bias(resample.month_year_bias(pairs)), ["bias_max"])


@query("selected_models", f"WITH {A.DAILY} SELECT d, 'tmax' AS model, round(tmax, 6) AS value, CAST(month(d) AS BIGINT) AS month, CAST(year(d) AS BIGINT) AS year FROM daily UNION ALL SELECT d, 'tmin', round(tmin, 6), month(d), year(d) FROM daily")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = resample.melted(A.daily_obs(spark, sf_dir), ["d"])
    out = resample.selected(long, ["tmax", "tmin"])
    return A.rounded(out.withColumns({"month": F.col("month").cast("long"), "year": F.col("year").cast("long")}), ["value"])


@query("brier", f"WITH {_JOINED} SELECT model, round({_BS}, 6) AS bs FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = skill.paired(*A.models(spark, sf_dir))
    return A.rounded(pairs.groupBy("model").agg(skill.brier(F.col("obs"), F.col("sim"), 10.0).alias("bs")), ["bs"])


@query("error_metrics", f"WITH {_JOINED} SELECT model, round(avg(obs - sim), 6) AS mbe, round(avg((obs - sim) ** 2), 6) AS mse FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = skill.paired(*A.models(spark, sf_dir))
    return A.rounded(pairs.groupBy("model").agg(skill.mbe(F.col("obs"), F.col("sim")).alias("mbe"), skill.mse(F.col("obs"), F.col("sim")).alias("mse")), ["mbe", "mse"])


@query("contingency", f"WITH {_CELLS_SQL} SELECT model, tp, tn, fp, fn FROM t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill.contingency_table(skill.paired(*A.models(spark, sf_dir)), 10.0)


@query("contingency_norm", f"WITH {_CELLS_SQL} SELECT model, " + ", ".join(f"round({c}::DOUBLE / (tp + tn + fp + fn), 6) AS {c}" for c in ("tp", "tn", "fp", "fn")) + " FROM t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(skill.contingency_table(skill.paired(*A.models(spark, sf_dir)), 10.0, norm=True), ["tp", "tn", "fp", "fn"])


@query("confusion_matrix", f"WITH {_CELLS_SQL} " + " UNION ALL ".join(f"SELECT model, '{c}' AS cell, {c} AS n, round({c} * 100.0::DOUBLE / (tp + tn + fp + fn), 6) AS percent FROM t" for c in ("tn", "fp", "fn", "tp")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(skill.confusion_matrix(skill.paired(*A.models(spark, sf_dir)), 10.0), ["percent"])


@query("taylor_points", f"WITH {_JOINED}, s AS (SELECT model, stddev_pop(sim) AS std, stddev_pop(obs) AS ref, corr(obs, sim) AS r FROM p GROUP BY 1) SELECT model, round(std, 6) AS std, round(acos(r), 6) AS theta, round(sqrt(greatest(0, ref ** 2 + std ** 2 - 2 * ref * std * r)), 6) AS rms FROM s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(skill.taylor_points(*A.models(spark, sf_dir)), ["std", "theta", "rms"])


_SIDE = "{n} AS (SELECT model, {c}, round(max(q), 9) AS quantile FROM (SELECT model, {c}, (2 * (rank() OVER (PARTITION BY model ORDER BY {c}) - 1) + count(*) OVER (PARTITION BY model, {c}) + 1) * 50.0::DOUBLE / count(*) OVER (PARTITION BY model) AS q FROM b) GROUP BY 1, 2)"


@query("qq_table", f"WITH {_JOINED}, b AS (SELECT * FROM p WHERE obs IS NOT NULL AND sim IS NOT NULL), {_SIDE.format(n='x', c='sim')}, {_SIDE.format(n='y', c='obs')} SELECT coalesce(x.model, y.model) AS model, round(coalesce(x.quantile, y.quantile), 6) AS quantile, round(sim, 6) AS predicted, round(obs, 6) AS observed FROM x FULL JOIN y ON x.model = y.model AND x.quantile = y.quantile")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(skill.equivalent_quantiles(skill.paired(*A.models(spark, sf_dir))), ["quantile", "predicted", "observed"])


@query("skill_resampled", f"WITH {A.MODELS}, o AS (SELECT CAST(date_trunc('month', d) AS DATE) AS d, avg(value) AS value FROM obs GROUP BY 1), m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS d, model, avg(value) AS value FROM models GROUP BY 1, 2) SELECT m.model AS model, round(avg(o.value - m.value), 6) AS bias FROM m LEFT JOIN o ON m.d = o.d GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, models = A.models(spark, sf_dir)
    out = skill.Skill(obs, models).resample("1M", "mean", skipna=True).skill()
    return A.rounded(out.select("model", "bias"), ["bias"])
