"""Files in and out, and streams."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo
from pyspark.sql import functions as F

from skyecho import schema
from skyecho.plans import registry
from skyecho.sources import fields, results, stations
from skyecho.streaming import continuous

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def station_files(tmp_path):
    for code, shift in (("S1", 0), ("S2", 10)):
        own = tmp_path / code
        own.mkdir()
        (own / "meta.csv").write_text(f"code,name,longitude,latitude,altitude\n{code},Station {code},-3.9,40.8,1147\nX,other,0,0,0\n")
        lines = "".join(f"2005-01-{d:02d} {h:02d}:00:00,{shift + d + h / 10 if (d, h) != (1, 6) else ''}\n" for d in (1, 2) for h in (0, 6, 12))
        (own / "TMPA.csv").write_text(",TMPA\n" + lines)
    return tmp_path


def test_stations_and_observations(spark, station_files):
    assert sorted(r.code for r in stations.stations(spark, str(station_files)).collect()) == ["S1", "S2"]
    got = {(r.station, r.d): r for r in stations.daily(spark, str(station_files), "TMPA").collect()}
    r = got["S2", date(2005, 1, 1)]
    assert (r.TMAX, r.TMIN) == (pytest.approx(12.2), pytest.approx(11.0)) and len(got) == 4
    one = stations.Station(spark, str(station_files / "S1"))
    assert one.code == "S1" and one.altitude == 1147 and one.get_data("TMPA", skipna=False).where("TMAX is null").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stations.observations(spark, str(station_files), ["NONE"]).count()


def test_fields_are_pruned(spark, tmp_path):
    rows = [(datetime(y, 1, 1, 12), 40.0, 0.0, v, 0, float(y)) for y in (2005, 2006) for v in ("u", "v")]
    fields.write_field(spark.createDataFrame(rows, schema.FIELD), str(tmp_path / "f"))
    got = fields.read_field(spark, str(tmp_path / "f"), ["u"], (2006, 2006))
    assert [(r.variable, r.value) for r in got.collect()] == [("u", 2006.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "variable" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert fields.open_field(spark, str(tmp_path / "f"), ["u", "v"], domain=(40, 40, 0, 0)).count() == 4
    assert fields.files_of("r", ["u"], [2005], ".nc") == {"u": ["r/y_2005/2005_u.nc"]}


def test_reconstructions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1", date(2005, 1, 1), "t", m, 1.0, 0.0, 2.0) for m in ("closest", "average5")], schema.RECONSTRUCTION)
    for kind in ("parquet", "csv"):
        results.write_reconstructions(df, str(tmp_path / kind), kind)
        got = results.read_reconstructions(spark, str(tmp_path / kind), "S1", "t", ["closest"], kind).collect()
        assert [(r.method, r.value, r.max_band) for r in got] == [("closest", 1.0, 2.0)]
    assert sorted(results.members(df, "method")) == ["average5", "closest"]


def test_config():
    got = results.read_config('{"stations": ["S1"], "training": [[2006, 1, 1], [2013, 12, 31]], "pool_sizes": [20, 50]}')
    assert got.training == (date(2006, 1, 1), date(2013, 12, 31)) and got.pool_sizes == [20, 50] and got.window_size == 10
    with pytest.raises(ValueError, match="unknown settings"):
        results.read_config('{"pool": 3}')


def test_daily_stream(spark, tmp_path):
    rows = [("S1", datetime(2005, 1, 1) + timedelta(hours=6 * i), "t", float(i)) for i in range(40)]
    spark.createDataFrame(rows, schema.OBSERVATIONS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = continuous.daily(continuous.read_observations(spark, str(tmp_path / "in"), schema.OBSERVATIONS), "mean")
    run = stream.writeStream.format("memory").queryName("daily_out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.d: r.value for r in spark.table("daily_out").collect()}
    assert got[date(2005, 1, 1)] == 1.5 and len(got) >= 6


def test_analogs_of_a_stream(spark, tmp_path):
    pcs = spark.createDataFrame([(0, date(2020, 1, 1) + timedelta(days=i), float(i)) for i in range(9)], "season int, d date, pc_0 double")
    pcs.where("pc_0 > 6").coalesce(1).write.parquet(str(tmp_path / "new"))
    found: list = []
    writer = continuous.analogs_of_new_days(spark.readStream.schema(pcs.schema).parquet(str(tmp_path / "new")), pcs.where("pc_0 <= 6"), pcs.select("d"), lambda df, n: found.extend(df.collect()), 2, 0)
    writer.trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.d.day, r.analog_d.day) for r in found} == {(8, 7), (8, 6), (9, 7), (9, 6)}


class _Variable:
    def __init__(self, values, dims):
        self.values, self.dims = values, dims

    def isel(self, at):
        values, dims = self.values, list(self.dims)
        for d, i in at.items():
            values = np.take(values, i, axis=dims.index(d))
            dims.remove(d)
        return _Variable(values, tuple(dims))

    def transpose(self, *dims):
        return _Variable(np.transpose(self.values, [self.dims.index(d) for d in dims]), dims)


class _Dataset(dict):
    """As much of a dataset of gridded variables as the reader uses."""

    @property
    def coords(self):
        return {k: v for k, v in self.items() if k != "t2m"}

    dims = ("time", "number", "longitude", "latitude")
    data_vars = ("t2m",)


def test_batches_of_grid_files():
    values = np.arange(24).reshape(2, 2, 3, 2)
    data = _Dataset(time=_Variable(np.array(["2005-01-01T00", "2005-01-01T12"], "datetime64[ns]"), ("time",)), number=_Variable(np.array([0, 1]), ("number",)), longitude=_Variable(np.array([-10.0, -5, 0]), ("longitude",)), latitude=_Variable(np.array([50.0, 40]), ("latitude",)), t2m=_Variable(values, ("time", "number", "longitude", "latitude")))
    batches = list(fields.batches_of(data, "t"))
    assert [b.num_rows for b in batches] == [6] * 4 and sorted(set(batches[1].column(4).to_pylist())) == [1]
    row = batches[3].to_pylist()[4]
    assert (row["latitude"], row["longitude"], row["value"], row["ts"]) == (40, -5, values[1, 1, 1, 1], datetime(2005, 1, 1, 12))
    assert len(list(fields.batches_of(data, "t", number=1))) == 2


def test_grid_file_lists(spark, tmp_path):
    (tmp_path / "y_2005").mkdir()
    (tmp_path / "y_2005" / "2005_t.nc").write_bytes(b"")
    there, missing = fields.found_files(spark, fields.files_of(str(tmp_path), ["t"], [2006, 2005], ".nc"))
    assert [x[-10:] for x in there["t"]] == ["/2005_t.nc"] and [x[-10:] for x in missing] == ["/2006_t.nc"]
    with pytest.raises(FileNotFoundError, match="no file for u"):
        fields.gridfiles(spark, fields.files_of(str(tmp_path), ["t", "u"], [2005], ".nc"))
    reader = fields.GridFileReader({"files": "t=a.nc,u=b.nc"})
    rest = list(reader.pushFilters([EqualTo(("variable",), "u"), EqualTo(("number",), 3), EqualTo(("value",), 1.0)]))
    assert len(rest) == 1 and [p.path for p in reader.partitions()] == ["b.nc"] and reader.number == 3


def test_series_of_points_and_their_cache(spark, tmp_path):
    rows = [(datetime(2005, 1, 1, 12) + timedelta(days=i), float(a), float(b), v, n, float(k * (i + 1) + n)) for i in range(2) for a in (50, 40) for b in (-10, -5) for v, k in (("t", 280), ("p", 0.001)) for n in (0, 1)]
    fields.write_field(spark.createDataFrame(rows, schema.FIELD), str(tmp_path / "field"))
    assert {r.variable: (r.latitude, r.longitude) for r in fields.read_axes(spark, str(tmp_path / "field")).collect()} == {v: ([40, 50], [-10, -5]) for v in "tp"}
    points = spark.createDataFrame([("S1", 41.0, -9.0), ("S2", 40.2, -9.5), ("S3", 52.0, 3.0)], "code string, latitude double, longitude double")
    get = lambda **k: fields.point_series(spark, str(tmp_path / "field"), points, ["t", "p"], names={"t": "TMEAN"}, kelvin=["t"], metres=["p"], **k)
    got = {(r.code, r.d.day, r.variable): r.value for r in get(number=1).collect()}
    assert len(got) == 12 and got["S1", 1, "TMEAN_1"] == pytest.approx(281 - 273.15) and got["S3", 2, "p_1"] == pytest.approx(1002)
    assert {r.variable for r in get(number=0).collect()} == {"TMEAN_0", "p_0"}
    made: list = []
    for _ in range(2):
        stored = fields.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or get(number=1))
    assert len(made) == 1 and stored.count() == 12
    whole = fields.open_field(spark, str(tmp_path / "field"), ["t"], domain=(40, 50, -10, -5), number=0)
    assert whole.count() == 2


def test_registry(spark):
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    df = registry.entry(spark)
    assert df.columns == ["season", "d", "variable", "method", "value", "min_band", "max_band"]
    assert df.where(F.col("value").isNull()).count() == 0


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
@pytest.mark.parametrize("name", ["knn_euclidean", "knn_window_centered_10", "recon_closest", "recon_quantilemap"])
def test_every_day_is_a_target(spark, name):
    duckdb = pytest.importorskip("duckdb")
    days = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    got = registry.queries()[name](spark, DATA)
    assert got.select("d").distinct().count() == days
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
        want = c.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
