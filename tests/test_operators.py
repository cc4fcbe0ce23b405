"""Operators on frames small enough to check by hand."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyecho.functions import calendar, meteo
from skyecho.functions.values import percentile_of_score
from skyecho.operators import analogs, grid, indices, pca, resample, skill
from skyecho.operators.predictor import Predictor

D0 = date(2020, 1, 1)


def day(i: int) -> date:
    return D0 + timedelta(days=i)


def test_missing_values_in_aggregates(spark):
    rows = [(day(0), 1.0), (day(0), None), (day(0), 3.0), (day(1), None), (day(2), float("nan"))]
    df = spark.createDataFrame(rows, "d date, value double")
    got = {r.period: r for r in resample.resample_all(df, ["sum", "mean", "std"]).collect()}
    assert got[day(0)].sum == 4 and got[day(0)].mean == 2 and got[day(0)].std == pytest.approx(1.414213562)
    assert got[day(1)].sum == 0 and got[day(1)].mean is None and got[day(2)].sum == 0
    strict = {r.period: r.value for r in resample.resample(df, "sum", skipna=False).collect()}
    assert strict == {day(0): None, day(1): None, day(2): None}


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([(D0, 1.0)], "d date, value double")
    with pytest.raises(ValueError, match="unknown aggregate"):
        resample.resample(df, "mode")
    with pytest.raises(ValueError, match="frequency"):
        resample.resample(df, "sum", "1W")
    with pytest.raises(ValueError, match="window type"):
        calendar.window_reach(3, "left")


def test_wind_and_humidity(spark):
    df = spark.createDataFrame([(10.0, 270.0), (10.0, 180.0), (5.0, 45.0)], "WSPD double, WDIR double")
    got = [(r.U, r.V) for r in meteo.wind_components(df).collect()]
    assert got[0] == pytest.approx((10, 0), abs=1e-9) and got[1] == pytest.approx((0, 10), abs=1e-9) and got[2] == pytest.approx((-3.535533906, -3.535533906))
    rh = meteo.relative_humidity(spark.createDataFrame([(283.0, 293.0)], "TDEW double, TMPA double")).first().RHMA
    assert rh == pytest.approx(51.995565681)
    with pytest.raises(ValueError, match="WDIR"):
        meteo.wind_components(df.drop("WDIR"))


PCS = [(0, 0), (1, 0), (0, 1), (3, 4), (0, 2), (2, 0), (0, 0), (6, 8)]
OBS = [10, 12, 11, 20, None, 14, 9, 30]
MAPPING = [5, 6, 5.5, 9, 7, 6.5, 4, 12]


@pytest.fixture(scope="module")
def space(spark):
    pcs = spark.createDataFrame([(0, day(i), float(a), float(b)) for i, (a, b) in enumerate(PCS)], "season int, d date, pc_0 double, pc_1 double")
    obs = spark.createDataFrame([(day(i), "t", float(v)) for i, v in enumerate(OBS) if v is not None], "d date, variable string, value double")
    mapping = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(MAPPING)], "d date, value double")
    return pcs, obs, mapping


@pytest.mark.parametrize(
    ("window", "first", "fourth"),
    [
        ((0, "centered"), [(0, 6), (1, 1), (1, 2)], [(1, 2), (2, 0), (2, 6)]),
        ((3, "centered"), [(0, 6), (1, 2), (2, 5)], [(2, 0), (2, 6), (5**0.5, 1)]),
        ((2, "forward"), [(0, 6), (1, 1), (1, 2)], [(2, 0), (2, 6), (5**0.5, 1)]),
        ((2, "back"), [(0, 6), (2, 5), (5, 3)], [(1, 2), (2, 0), (5**0.5, 1)]),
    ],
)
def test_pools_and_exclusion_windows(space, window, first, fourth):
    pcs, obs, _ = space
    got: dict[int, list] = {}
    for r in analogs.analog_pool(pcs, obs, pcs.select("d"), 3, *window).orderBy("d", "rank").collect():
        got.setdefault((r.d - D0).days, []).append((r.distance, (r.analog_d - D0).days))
    for target, want in ((0, first), (4, fourth)):
        assert [x[1] for x in got[target]] == [x[1] for x in want]
        assert [x[0] for x in got[target]] == pytest.approx([x[0] for x in want])


def test_days_that_are_no_targets_stay_candidates(spark, space):
    pcs, obs, _ = space
    only = spark.createDataFrame([(day(4),)], "d date")
    got = [(r.analog_d - D0).days for r in analogs.analog_pool(pcs, obs, only, 3, 3).orderBy("rank").collect()]
    assert got == [2, 0, 6]


def test_pool_of_many_blocks(space, monkeypatch):
    pcs, obs, _ = space
    want = sorted(map(tuple, analogs.analog_pool(pcs, obs, pcs.select("d"), 3).collect()))
    monkeypatch.setattr(analogs, "TARGET_ROWS", 2)
    monkeypatch.setattr(analogs, "CANDIDATE_ROWS", 3)
    monkeypatch.setattr(analogs, "CELLS", 4)
    assert sorted(map(tuple, analogs.analog_pool(pcs, obs, pcs.select("d"), 3).collect())) == want


def test_methods(space):
    pcs, obs, mapping = space
    pool = analogs.analog_pool(pcs, obs, pcs.select("d"), 3, 0)
    of = lambda df, i: df.where(F.col("d") == day(i)).first()
    r = of(analogs.reconstruct(pool, obs), 4)
    assert (r.value, r.min_band, r.max_band) == (11, 9, 11)
    r = of(analogs.reconstruct(pool, obs, "average", 2), 4)
    assert r.value == pytest.approx(10.8) and (r.min_band, r.max_band) == (10, 11)
    assert of(analogs.reconstruct(pool, obs, "average", 2), 0).value is None
    assert of(analogs.reconstruct(pool, obs, "average", 2, mode="standard"), 0).value == 9
    assert of(analogs.reconstruct(pool, obs, "quantilemap", mapping=mapping), 4).value == 11
    with pytest.raises(ValueError, match="unknown method"):
        analogs.reconstruct(pool, obs, "nearest")
    assert analogs.sweep(pool, obs, [3], [2], mapping).select("method").distinct().count() == 3


def test_mahalanobis_against_numpy(space):
    pcs, obs, _ = space
    s = np.linalg.pinv(np.cov(np.array(PCS, float).T))
    for r in analogs.analog_pool(pcs, obs, pcs.select("d"), 3, 0, distance="mahalanobis").collect():
        diff = np.array(PCS[(r.d - D0).days]) - np.array(PCS[(r.analog_d - D0).days])
        assert r.distance == pytest.approx(math.sqrt(max(0, diff @ s @ diff)), abs=1e-9)


def test_percentile_of_score(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (3, 1, 2, 2, 5)], "k int, v double")
    got = {r.v: r.p for r in df.withColumn("p", percentile_of_score(F.col("v"), ["k"])).collect()}
    assert got == {3: 80, 1: 20, 2: 50, 5: 100}


def test_runs(spark):
    rain = [0.5, 0, 2, 1, None, 0.2, 0.3, 0.1, 5]
    df = spark.createDataFrame([(day(i), None if v is None else float(v)) for i, v in enumerate(rain)], "d date, pcp double")
    got = [r.run for r in indices.runs(df, F.when(F.col("pcp") > 1, 0).when(F.col("pcp") <= 1, 1)).orderBy("d").collect()]
    assert got == [1, 2, 0, 1, None, 1, 2, 3, 0]
    assert indices.dry_spell(df).first().cdd == 3


@pytest.mark.parametrize("keys", [("station",), ()])
def test_rain_at_its_own_percentile(spark, keys):
    """The second wettest of 21 days is the limit itself, also if the last digits change with every reading."""
    unsteady = F.udf(lambda x: x * (1 + random.random() * 1e-12), "double").asNondeterministic()
    stations = [f"s{i}" for i in range(20)] if keys else ["s0"]
    rain = {**{day(i): 10.0 * (i + 1) for i in range(21)}, day(30): 1000.0}
    rows = [(s, d, v) for s in [*stations, *([None] if keys else [])] for d, v in rain.items()] + ([("late", day(30), 5.0)] if keys else [])
    df = spark.createDataFrame(rows, "station string, d date, pcp double").withColumn("pcp", unsteady("pcp"))
    base = (day(0), day(20))
    flags = indices.rain_over_percentile(df, 0.95, "r", keys, base).collect()
    assert len(flags) == len(rows)
    total = indices.rain_over_percentile(df, 0.95, "r", keys, base, "standard").collect()
    if keys:  # no limit without a station or a day of the base period
        assert {r.r for r in flags if r.station in (None, "late")} == {None}
        assert {r.r for r in total if r.station in (None, "late")} == {0}
        flags, total = ([r for r in x if r.station in stations] for x in (flags, total))
    assert sorted(r.d for r in flags if r.r == 1) == sorted([day(20), day(30)] * len(stations))
    assert [r.r for r in total] == pytest.approx([1210.0] * len(stations))


def test_skill(spark):
    rows = list(zip(range(5), [1, 2, 3, 4, None], [2, 2, 2, 6, 1], [0, 2, 5, 4, 1], strict=True))
    obs = spark.createDataFrame([(day(i), None if o is None else float(o)) for i, o, _, _ in rows], "d date, value double")
    models = spark.createDataFrame([(day(i), m, float(v)) for i, _, s, r in rows for m, v in (("sim", s), ("ref", r))], "d date, model string, value double")
    got = skill.skill_table(obs, models, "ref", 3.0).where("model = 'sim'").first()
    assert got.bias == pytest.approx(-0.5) and got.rmse == pytest.approx(1.224744871) and got.r == pytest.approx(0.774596669) and got.std == pytest.approx(1.743559577)
    assert got.ssmse == pytest.approx(-0.2) and got.bs == pytest.approx(0.25) and got.hss == 9999
    assert skill.skill_table(obs, models, mode="standard").where("model = 'sim'").first().bias == pytest.approx(0.5)
    t = skill.contingency_table(skill.paired(obs, models), 3.0).where("model = 'sim'").first()
    assert (t.tp, t.tn, t.fp, t.fn) == (1, 2, 0, 1)


def test_hydrological_years(spark):
    days = [date(2005, 1, 15), date(2005, 9, 30), date(2005, 10, 1), date(2005, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [(r.a, r.b) for r in df.select("d", calendar.hydro_year(F.col("d")).alias("a"), calendar.hydro_year(F.col("d"), "standard").alias("b")).orderBy("d").collect()]
    assert got == [(2005, 2005), (2005, 2005), (2004, 2006), (2004, 2006)]


def test_nearest_gridpoint_and_crop(spark):
    cells = spark.createDataFrame([(float(a), float(b), 1.0) for a in (50, 40, 30) for b in (-10, -5, 0, 5)], "latitude double, longitude double, value double")
    got = grid.nearest_gridpoint(cells, 40.83, -3.9).first()
    assert (got.ilat, got.ilon) == (1, 1)
    assert grid.nearest_gridpoint(cells, 45, 0).first().ilat == 0
    assert grid.crop(cells, 30, 50, -10, 5).count() == 6 and grid.crop(cells, 30, 50, -10, 5, mode="standard").count() == 12
    assert grid.crop(cells, 40, 40, 0, 0).count() == 1


def test_lower_adjacent_value(spark):
    df = spark.createDataFrame([(float(h), 1.0) for h in (60, 70, 80, 90, 95)] + [(10.0, 0.0)], "humidity double, precipitation double")
    assert resample.lower_adjacent_humidity(df).first().lower_adjacent == 40


def test_components(spark):
    values = [(1, 2, 0), (2, 1, 1), (3, 4, 2), (4, 3, 5)]
    cells = spark.createDataFrame([(day(i), 0.0, float(j), float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "d date, latitude double, longitude double, value double")
    days = pca.complete_days(grid.anomalies(cells, standardize=True))
    model = pca.fit(days, 3)
    assert [r.eigenvalue for r in model.orderBy("mode").collect()] == pytest.approx([3.171571, 0.784900, 0.043529], abs=1e-6)
    got = [abs(r.pc_0) for r in pca.project(days, model).orderBy("d").collect()]
    assert got == pytest.approx([0.960702870, 0.705394750, 0.523591550, 1.142506080], abs=1e-6)


def test_cells_without_variance_do_not_drop_days(spark):
    cells = spark.createDataFrame([(day(i), 0.0, float(j), float(i * j)) for i in range(4) for j in range(2)], "d date, latitude double, longitude double, value double")
    assert pca.complete_days(grid.anomalies(cells, standardize=True)).count() == 4


def test_pool_properties(space):
    pcs, obs, _ = space
    pool = analogs.analog_pool(pcs, obs, pcs.select("d"), 5, 2)
    rows = pool.orderBy("d", "rank").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.d != b.d or (a.distance <= b.distance and b.rank == a.rank + 1)
    assert all(r.d != r.analog_d and not -1 <= (r.analog_d - r.d).days <= 1 and r.rank < 5 for r in rows)


def test_plans(space, monkeypatch):
    pcs, obs, _ = space
    monkeypatch.setattr(analogs, "CANDIDATE_ROWS", 3)
    plan = analogs.analog_pool(pcs, obs, pcs.select("d"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_days_without_one_variable_are_no_candidates(spark):
    pcs = spark.createDataFrame([(0, day(i), float(i)) for i in (0, 20, 41)], "season int, d date, pc_0 double")
    obs = spark.createDataFrame([(day(0), "x", 1.0), (day(0), "n", 1.0), (day(20), "x", 2.0), (day(20), "n", None), (day(41), "x", 3.0), (day(41), "n", 3.0)], "d date, variable string, value double")
    own = analogs.Analogs(pcs, obs, pcs.select("d"))
    value = lambda **k: {r.variable: r.value for r in own.reconstruct(5, **k).where(F.col("d") == day(0)).collect()}
    assert value() == {"x": 3.0, "n": 3.0} and value(mode="standard") == {"x": 2.0, "n": 3.0}
    with pytest.warns(UserWarning, match="under 10 days"):
        own.get_pool(5, 3)


def test_unknown_distance(space):
    with pytest.raises(ValueError, match="unknown distance"):
        analogs.analog_pool(space[0], space[1], space[0].select("d"), distance="cosine")


def test_more_cells_than_days(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 3)) @ rng.standard_normal((3, 20_000)) + 0.01 * rng.standard_normal((30, 20_000))
    days = spark.createDataFrame([(0, day(i), row.tolist()) for i, row in enumerate(x)], "season int, d date, x array<double>")
    model = pca.fit(days, 3)
    pca.save(model, str(tmp_path / "modes"))
    rows = pca.load(spark, str(tmp_path / "modes")).orderBy("mode").collect()
    values, vectors = np.linalg.eigh(x @ x.T / 29)
    assert [r.eigenvalue for r in rows] == pytest.approx(values[::-1][:3]) and sum(r.variance_fraction for r in rows) == pytest.approx(values[-3:].sum() / values.sum())
    for k, r in enumerate(rows):
        want = x.T @ vectors[:, -1 - k]
        want /= np.linalg.norm(want) * np.sign(want[np.abs(want).argmax()])
        assert np.allclose(r.loading, want, atol=1e-9)


@pytest.mark.parametrize("scaling", [0, 1, 2])
def test_scalings_and_the_predictor(spark, scaling, tmp_path):
    values = np.array([(1, 2, 0), (2, 1, 1), (3, 4, 2), (4, 3, 5)], float)
    cells = spark.createDataFrame([(day(i), 0.0, float(j), float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "d date, latitude double, longitude double, value double")
    z = (values - values.mean(axis=0)) / values.std(axis=0)
    lam, vec = np.linalg.eigh(z.T @ z / 3)
    lam, vec = lam[::-1], vec[:, ::-1]
    want = np.abs(z @ vec * {0: 1, 1: 1 / np.sqrt(lam), 2: np.sqrt(lam)}[scaling])
    own = Predictor(cells)
    got = [[abs(r.pc_0), abs(r.pc_1), abs(r.pc_2)] for r in own.pcs(3, scaling).orderBy("d").collect()]
    assert np.allclose(got, want, atol=1e-6)
    own.save(str(tmp_path / "modes"))
    again = Predictor(cells).load(str(tmp_path / "modes")).pcs(3, scaling, project=cells)
    assert np.allclose([[abs(r.pc_0), abs(r.pc_1), abs(r.pc_2)] for r in again.orderBy("d").collect()], want, atol=1e-6)
    split = Predictor(cells).pcs(1, scaling, training=(day(0), day(1)))
    assert split.count() == 4


def test_tables_of_verification(spark):
    obs = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate((1, 2, 3, 4))], "d date, value double")
    assert skill.reference_std(obs).first().std_ref == pytest.approx(1.290994449)
    wide = spark.createDataFrame([(day(0), 1.0, 2.0)], "d date, my_tmax double, my_tmin double")
    assert resample.renamed(wide, {"tmax": "TMAX", "tmin": "TMIN"}).columns == ["d", "TMAX", "TMIN"]
    with pytest.raises(ValueError, match="one name"):
        resample.renamed(wide, {"my_t": "T"})
    got = resample.selected(resample.melted(wide, ["d"]), ["my_tmin"]).first()
    assert (got.model, got.value, got.month, got.year) == ("my_tmin", 2.0, 1, 2020)
    pairs = spark.createDataFrame([(day(0), 1.0, 5.0), (day(40), 3.0, 1.0)], "d date, predicted double, observed double")
    assert resample.largest_bias(resample.month_year_bias(pairs)).first().bias_max == 4
