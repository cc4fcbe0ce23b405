"""Analog search in principal-component space and reconstruction from the pools.

Everything lives in long tables: ``pcs(season, d, pc_0 .. pc_n)``, ``pool(season,
d, rank, analog_d, distance)`` with rank from 0, ``recon(d, variable, method,
value, min_band, max_band)``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyecho.functions.calendar import window_reach
from skyecho.functions.values import percentile_of_score
from skyecho.semantics import REFERENCE, is_reference

#: Targets and candidates of a season that meet in one task; more are dealt in blocks, and each pair of blocks meets once.
TARGET_ROWS, CANDIDATE_ROWS = 16_384, 65_536
#: Distances that a task holds at once.
CELLS = 1 << 22


def component_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("pc_")), key=lambda c: int(c[3:]))


def packed(pcs: DataFrame) -> DataFrame:
    """Components as one array, without days that miss one. A filter over many columns makes the planner's
    inference of constraints explode; over one array it doesn't."""
    pc = F.array(*(F.col(c).cast("double") for c in component_columns(pcs)))
    return pcs.select("season", "d", pc.alias("pc")).where(~F.exists("pc", lambda x: x.isNull()))


def inverse_covariances(pcs: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Of each season, from one aggregation of n (n + 1) / 2 numbers per season; the pseudo-inverse if singular."""
    names = list(range(n))
    pairs = [(i, j) for i in names for j in names if j >= i]
    part = lambda i: F.get("pc", F.lit(i))
    rows = pcs.groupBy("season").agg(*(F.covar_samp(part(i), part(j)).alias(f"c_{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in rows:
        s = np.zeros((len(names), len(names)))
        for i, j in pairs:
            s[i, j] = s[j, i] = r[f"c_{i}_{j}"] if r[f"c_{i}_{j}"] is not None else np.nan
        if np.isfinite(s).all():
            out[r["season"]] = np.linalg.pinv(s)
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("pc").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.empty((0, 0))


def _nearest(size: int, before: int, behind: int, keys: Sequence[str], inverses: dict[int, np.ndarray] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of targets and one of candidates: each target's ``size`` nearest. One matrix product measures all
    pairs; what may be among the nearest is measured again by its differences, which decides order and ties."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t, c = _matrix(left), _matrix(right)
        day, other = left.column("day").to_numpy(), right.column("day").to_numpy()
        order = np.argsort(other, kind="stable")
        c, other, targeted = c[order], other[order], right.column("is_target").to_numpy(zero_copy_only=False)[order]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        inverse = None
        if len(t) and len(c) and inverses is not None:
            inverse = inverses.get(left.column("season")[0].as_py())
            if inverse is None:  # no distance in this season: the earliest days stand first
                c = np.full_like(c, np.nan)
        side = c if inverse is None else c @ inverse
        own = (side * c).sum(axis=1)
        most = float(np.nanmax(np.abs(own))) if len(own) and np.isfinite(own).any() else 0.0
        step = max(1, CELLS // max(1, len(c)))
        for at in range(0, len(t) if len(c) else 0, step):
            part = t[at : at + step]
            square = (part * part).sum(axis=1) if inverse is None else ((part @ inverse) * part).sum(axis=1)
            near = square[:, None] + own[None, :] - 2 * (part @ side.T)
            gap = other[None, :] - day[at : at + step, None]
            near[(targeted[None, :] & (gap >= -before) & (gap <= behind)) | (gap == 0)] = np.inf
            for i, row in enumerate(near):
                open_ = int((row < np.inf).sum()) if not np.isnan(row).any() else 0
                if open_ > size:
                    reach = np.partition(row, size - 1)[size - 1] + 1e-9 * (1 + abs(square[i]) + most)
                    places = np.flatnonzero(row <= reach)
                else:
                    places = np.flatnonzero(row != np.inf)
                diff = c[places] - part[i]
                moved = diff if inverse is None else diff @ inverse
                distance = np.sqrt(np.maximum((moved * diff).sum(axis=1), 0))
                best = np.lexsort((other[places], distance))[:size]
                found.append((at + i, places[best], distance[best]))
        who = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)
        places = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.int64)
        rank = np.concatenate([np.arange(len(x[1])) for x in found]) if found else np.empty(0, np.int64)
        distance = np.concatenate([x[2] for x in found]) if found else np.empty(0)
        out = {k: left.column(k).take(pa.array(who)) for k in keys}
        return pa.table(out | {"day": pa.array(day[who] if len(who) else np.empty(0), pa.int32()), "rank": pa.array(rank, pa.int32()), "analog": pa.array(other[places] if len(places) else np.empty(0), pa.int32()), "distance": pa.array(np.where(np.isnan(distance), None, distance) if np.isnan(distance).any() else distance, pa.float64())})

    return run


def analog_pool(pcs: DataFrame, observed: DataFrame, targets: DataFrame, size: int = 100, vw_size: int = 10, vw_type: str = "centered", distance: str = "euclidean", by: Sequence[str] = ()) -> DataFrame:
    """For every target day the ``size`` nearest observed days of its season, nearest first, ties to
    the earlier day; a smaller pool if there are fewer.

    ``observed`` and ``targets`` have a column d. A day is no candidate for a target in
    whose exclusion window it lies if it is a target itself; the target's own day never is.
    Days with a missing component take no part. With ``by``, columns of ``observed`` such as a
    station, each of their values has candidates and pools of its own.

    Targets and candidates are dealt in blocks of a season, and each pair of blocks is one
    task: a matrix product, of which only the nearest leave the task.
    """
    names = component_columns(pcs)
    before, behind = window_reach(vw_size, vw_type)
    full = packed(pcs)
    if distance not in ("euclidean", "mahalanobis"):
        raise ValueError(f"unknown distance {distance}")
    inverses = inverse_covariances(full, len(names)) if distance == "mahalanobis" else None
    days = observed.select(*by, "d").distinct()
    t = full.join(targets.select("d").distinct(), "d", "left_semi")
    marked = full.join(targets.select("d").distinct().withColumn("is_target", F.lit(True)), "d", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    c = marked.join(days, "d") if by else marked.join(days, "d", "left_semi")
    if by:
        t = t.crossJoin(F.broadcast(days.select(*by).distinct()))  # a row per station or variable
    keys = [*by, "season"]
    # One small job tells how many blocks there are.
    counts = t.groupBy(*keys).agg(F.count("*").alias("t")).join(c.groupBy(*keys).agg(F.count("*").alias("c")), keys)
    most = counts.agg(F.max("t"), F.max("c")).first()
    here, there = (max(1, -(-(n or 0) // rows)) for n, rows in zip(most, (TARGET_ROWS, CANDIDATE_ROWS), strict=True))
    block = lambda n: F.pmod(F.xxhash64("d"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # New names on one side, as both come from one table.
    left = t.select(*(F.col(k).alias(k) for k in keys), F.unix_date("d").alias("day"), F.col("pc").alias("pc"), block(here).alias("_t"), every(there).alias("_c"))
    right = c.select(*keys, F.unix_date("d").alias("day"), "is_target", "pc", block(there).alias("_c"), every(here).alias("_t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*keys).schema)
    met = left.groupBy(*keys, "_t", "_c").cogroup(right.groupBy(*keys, "_t", "_c"))
    near = met.applyInArrow(_nearest(size, before, behind, keys, inverses), f"{kinds}, day int, rank int, analog int, distance double")
    if there > 1:
        order = Window.partitionBy(*keys, "day").orderBy("distance", "analog")
        # The comparison of the 1-based number itself lets the planner limit groups before the shuffle.
        near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).withColumn("rank", F.col("n") - 1)
    return near.select(*keys, F.date_from_unix_date("day").alias("d"), "rank", F.date_from_unix_date("analog").alias("analog_d"), "distance")


def observed_pool(pool: DataFrame, observed: DataFrame, value: str = "value", keys: Sequence[str] = ("variable",)) -> DataFrame:
    """The pool with the observed value (of each variable) on every analog day; columns that both have, such as a station, agree."""
    on = ["analog_d", *(k for k in keys if k in pool.columns)]
    return pool.join(observed.select(F.col("d").alias("analog_d"), *keys, F.col(value).alias("value")), on)


def closest(pool: DataFrame, keys: Sequence[str] = ("season", "d", "variable")) -> DataFrame:
    """The value of the nearest analog; bands over the whole pool."""
    return pool.groupBy(*keys).agg(F.min_by("value", "rank").alias("value"), F.min("value").alias("min_band"), F.max("value").alias("max_band")).withColumn("method", F.lit("closest"))


def weighted_average(pool: DataFrame, sample: int, keys: Sequence[str] = ("season", "d", "variable"), mode: str = REFERENCE) -> DataFrame:
    """The mean of the first ``sample`` analogs weighted by 1/distance^2; bands over those. With an analog at
    distance 0: null in ``reference`` mode, the mean of such analogs in ``standard`` mode."""
    if sample < 1:
        raise ValueError("the sample must have an analog at least")
    used = pool.where(F.col("rank") < sample)
    weight = F.try_divide(F.lit(1.0), F.col("distance") * F.col("distance"))
    value = F.try_divide(F.sum(F.col("value") * weight), F.sum(F.when(F.col("value").isNotNull(), weight)))
    exact = F.avg(F.when(F.col("distance") == 0, F.col("value")))
    hit = F.min("distance") == 0
    out = F.when(~hit, value) if is_reference(mode) else F.when(hit, exact).otherwise(value)
    return used.groupBy(*keys).agg(out.alias("value"), F.min("value").alias("min_band"), F.max("value").alias("max_band")).withColumn("method", F.lit(f"average{sample}"))


def quantile_map(pool: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("season", "d", "variable"), value: str = "value") -> DataFrame:
    """The analog whose value has the percentile in the pool that the target's mapping value has among the
    mapping values of its pool and itself; ties to the nearer analog. Bands over the whole pool."""
    of = mapping.select(F.col("d").alias("_d"), F.col(value).alias("_m"))
    own = pool.join(of.withColumnsRenamed({"_d": "d", "_m": "own_map"}), "d").join(of.withColumnsRenamed({"_d": "analog_d", "_m": "map"}), "analog_d", "left")
    scored = own.withColumn("pct", percentile_of_score(F.col("value"), keys))
    # The target's percentile among k + 1 values needs counts only: those below it and those up to it, itself included.
    group = Window.partitionBy(*keys)
    below = F.sum(F.when(F.col("map") < F.col("own_map"), 1).otherwise(0)).over(group)
    up_to = F.sum(F.when(F.col("map") <= F.col("own_map"), 1).otherwise(0)).over(group) + 1
    n = F.count("map").over(group) + 1
    target = F.when(F.col("own_map").isNotNull(), (below + up_to + 1) * 50.0 / n)
    chosen = scored.withColumn("target", target).withColumn("away", F.abs(F.col("pct") - F.col("target")))
    # Rounding stands in for exact ties of percentiles computed along different ways.
    by = F.when(F.col("away").isNotNull(), F.struct(F.round("away", 9), "rank"))
    return chosen.groupBy(*keys).agg(F.min_by("value", by).alias("value"), F.min("value").alias("min_band"), F.max("value").alias("max_band")).withColumn("method", F.lit("quantilemap"))


def reconstruct(pool: DataFrame, observed: DataFrame, method: str = "closest", sample: int | None = None, mapping: DataFrame | None = None, mode: str = REFERENCE, by: Sequence[str] = ()) -> DataFrame:
    """One method on a pool and long observations (``by``, d, variable, value)."""
    keys = (*by, "season", "d", "variable")
    own = observed_pool(pool, observed, keys=(*by, "variable"))
    if method == "closest":
        return closest(own, keys)
    if method == "average":
        if sample is None:
            raise ValueError("average needs a sample size")
        return weighted_average(own, sample, keys, mode)
    if method == "quantilemap":
        if mapping is None:
            raise ValueError("quantilemap needs a mapping variable")
        return quantile_map(own, mapping, keys)
    raise ValueError(f"unknown method {method}")


def sweep(pool: DataFrame, observed: DataFrame, pool_sizes: Sequence[int], samples: Sequence[int], mapping: DataFrame | None = None, mode: str = REFERENCE, by: Sequence[str] = ()) -> DataFrame:
    """closest and averages on the smallest pool, quantile mapping on each: all out of one pool of the
    largest size, as smaller ones are its first ranks."""
    keys = (*by, "season", "d", "variable")
    own = observed_pool(pool, observed, keys=(*by, "variable"))
    least = own.where(F.col("rank") < min(pool_sizes))
    parts = [closest(least, keys), *(weighted_average(least, m, keys, mode) for m in samples)]
    if mapping is not None:
        parts += [quantile_map(own.where(F.col("rank") < k), mapping, keys).withColumn("method", F.lit(f"quantilemap{k}")) for k in pool_sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidate_days(observations: DataFrame, by: Sequence[str] = (), mode: str = REFERENCE) -> DataFrame:
    """The days that can be analogs. ``reference``: those on which every variable (of the station) is observed;
    ``standard``: each variable's own, with a column ``variable``."""
    known = observations.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if not is_reference(mode):
        return known.select(*by, "variable", "d").distinct()
    kept = known.groupBy(*by, "d").agg(F.count_distinct("variable").alias("n"))
    wanted = observations.groupBy(*by).agg(F.count_distinct("variable").alias("n"))
    # A row per station; without stations a single number.
    both = kept.join(F.broadcast(wanted), [*by, "n"], "left_semi")
    return both.select(*by, "d")


def reconstruct_all(pcs: DataFrame, observations: DataFrame, dates: DataFrame, pool_sizes: Sequence[int], samples: Sequence[int], mapping: DataFrame | None = None, vw_size: int = 10, vw_type: str = "centered", distance: str = "euclidean", mode: str = REFERENCE) -> DataFrame:
    """Every station, variable and method in one plan: ``station, season, d, variable, method`` and the values.
    ``sources.results.write_reconstructions`` stores it by station, variable and method."""
    by = ("station",) if is_reference(mode) else ("station", "variable")
    days = candidate_days(observations, ("station",), mode)
    pool = analog_pool(pcs, days, dates, max(pool_sizes), vw_size, vw_type, distance, by)
    return sweep(pool, observations, pool_sizes, samples, mapping, mode, ("station",))


class Analogs:
    """Pools and reconstructions of one predictor space and the observations (d, variable, value) of one station."""

    def __init__(self, pcs: DataFrame, observations: DataFrame, dates: DataFrame) -> None:
        self.pcs, self.observations, self.dates = pcs, observations, dates

    def get_pool(self, size: int = 100, vw_size: int = 10, vw_type: str = "centered", distance: str = "euclidean", mode: str = REFERENCE) -> DataFrame:
        """One pool for all variables (``reference``), or one for each (``standard``)."""
        if vw_size < 10:
            warnings.warn("an exclusion window under 10 days lets analogs be of the target's own weather", stacklevel=2)
        by = () if is_reference(mode) else ("variable",)
        return analog_pool(self.pcs, candidate_days(self.observations, (), mode), self.dates, size, vw_size, vw_type, distance, by)

    def reconstruct(self, pool_size: int = 100, method: str = "closest", sample_size: int | None = None, mapping_variable: DataFrame | None = None, vw_size: int = 10, vw_type: str = "centered", distance: str = "euclidean", mode: str = REFERENCE) -> DataFrame:
        return reconstruct(self.get_pool(pool_size, vw_size, vw_type, distance, mode), self.observations, method, sample_size, mapping_variable, mode)
