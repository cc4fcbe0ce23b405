"""Principal components by season: fitting, scaling, projecting, storing.

The fit solves one symmetric matrix per season, of its days or of its cells,
whichever are fewer. Blocks of the other side are multiplied by themselves, and
their products leave in strips, which are summed strip by strip: a task holds a
matrix of that size, never all values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_BLOCKS = 64
#: Cells of a block, and strips of a product.
CELL_BLOCK, STRIPS = 512, 32
MODES = "season int, mode int, eigenvalue double, variance_fraction double, loading array<double>"


def complete_days(anomalies: DataFrame, cell: Sequence[str] = ("latitude", "longitude"), d: str = "d") -> DataFrame:
    """Anomalies as arrays over the cells (in order), one row per season and day that has every cell that varies."""
    varying = anomalies.where(F.col("value").isNotNull())
    rows = varying.groupBy("season", d).agg(F.sort_array(F.collect_list(F.struct(*cell, "value"))).alias("x"))
    n = varying.groupBy("season").agg(F.count_distinct(*cell).alias("n"))
    return rows.join(F.broadcast(n), "season").where(F.size("x") == F.col("n")).select("season", d, F.col("x.value").alias("x"))  # a row per season


def _strips(season: int, product: np.ndarray) -> pd.DataFrame:
    """The rows of a product in at most STRIPS parts."""
    bounds = np.linspace(0, len(product), min(STRIPS, len(product)) + 1).astype(int)
    return pd.DataFrame({"season": season, "strip": np.arange(len(bounds) - 1), "part": [product[a:b].ravel() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})


def _summed(own: pd.DataFrame) -> pd.DataFrame:
    total = own["part"].iloc[0].copy()
    for part in own["part"].iloc[1:]:
        total += part
    return pd.DataFrame({"season": [int(own["season"].iloc[0])], "strip": [int(own["strip"].iloc[0])], "part": [total]})


def _decomposed(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first, none below 0) and vectors of the matrix whose strips these are."""
    flat = np.concatenate(own.sort_values("strip")["part"].to_list())
    size = int(round(len(flat) ** 0.5))
    values, vectors = np.linalg.eigh(flat.reshape(size, size))
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0), vectors[:, order]


def _modes(season: int, values: np.ndarray, loadings: np.ndarray, freedom: int, npcs: int, total: float) -> pd.DataFrame:
    """Rows of the leading modes; the largest entry of a loading (columns) is positive."""
    k = min(npcs, loadings.shape[1])
    loadings = loadings[:, :k]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    loadings = loadings * np.where(signs == 0, 1, signs)
    return pd.DataFrame({"season": season, "mode": np.arange(k, dtype=np.int32), "eigenvalue": values[:k] / freedom, "variance_fraction": values[:k] / total if total else np.nan, "loading": list(loadings.T)})


def fit(days: DataFrame, npcs: int, d: str = "d") -> DataFrame:
    """``season, mode, eigenvalue, variance_fraction, loading`` of the leading modes; loadings have length 1 and
    their largest entry is positive. No centring (anomalies have their mean taken off already)."""
    sizes = {r["season"]: (r["n"], r["p"]) for r in days.groupBy("season").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).collect()}  # a row per season
    by_cells = [k for k, (n, p) in sizes.items() if n >= p]
    by_days = [k for k, (n, p) in sizes.items() if n < p]
    of = lambda own: days.where(F.col("season").isin(own) if own else F.lit(False))
    strips = "season int, strip int, part array<double>"

    def by_cell(own: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(own["x"].to_numpy())
        return _strips(int(own["season"].iloc[0]), x.T @ x)

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        season = int(own["season"].iloc[0])
        values, vectors = _decomposed(own)
        return _modes(season, values, vectors, max(1, sizes[season][0] - 1), npcs, values.sum())

    blocks = of(by_cells).withColumn("block", F.pmod(F.xxhash64(d), F.lit(DAY_BLOCKS)))
    products = blocks.groupBy("season", "block").applyInPandas(by_cell, strips)
    out = products.groupBy("season", "strip").applyInPandas(_summed, strips).groupBy("season").applyInPandas(solve, MODES)
    if not by_days:
        return out

    # Fewer days than cells: the days' products with each other have the same eigenvalues, and lead to the loadings.
    def by_day(own: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(own.sort_values("at")["x"].to_numpy())
        return _strips(int(own["season"].iloc[0]), x @ x.T)

    def solve_days(own: pd.DataFrame) -> pd.DataFrame:
        season = int(own["season"].iloc[0])
        values, vectors = _decomposed(own)
        k = max(1, min(npcs, int((values > values[0] * 1e-13).sum())))
        return pd.DataFrame({"season": season, "mode": np.arange(k, dtype=np.int32), "value": values[:k], "total": values.sum(), "u": list(vectors[:, :k].T)})

    def load(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(left.sort_values("at")["x"].to_numpy())
        right = right.sort_values("mode")
        part = x.T @ np.vstack(right["u"].to_numpy()).T / np.sqrt(np.maximum(right["value"].to_numpy(), 1e-300))
        return pd.DataFrame({"season": int(left["season"].iloc[0]), "block": int(left["block"].iloc[0]), "mode": right["mode"].to_numpy(), "value": right["value"].to_numpy(), "total": right["total"].to_numpy(), "part": list(part.T)})

    def joined(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["mode", "block"])
        season, first = int(own["season"].iloc[0]), own.groupby("mode").first()
        loadings = np.stack([np.concatenate(x.to_list()) for _, x in own.groupby("mode")["part"]], axis=1)
        return _modes(season, first["value"].to_numpy(), loadings, max(1, sizes[season][0] - 1), npcs, float(first["total"].iloc[0]))

    # Days are numbered by their date within a task: every block of cells has all days of the season.
    most = max(sizes[k][1] for k in by_days)
    cut = F.explode(F.sequence(F.lit(0), F.lit(-(-most // CELL_BLOCK) - 1)))
    sliced = of(by_days).select("season", F.unix_date(F.col(d).cast("date")).alias("at"), "x", cut.alias("block")).select("season", "at", "block", F.slice("x", F.col("block") * CELL_BLOCK + 1, CELL_BLOCK).alias("x")).where(F.size("x") > 0)
    products = sliced.groupBy("season", "block").applyInPandas(by_day, strips)
    solved = products.groupBy("season", "strip").applyInPandas(_summed, strips).groupBy("season").applyInPandas(solve_days, "season int, mode int, value double, total double, u array<double>")
    spread = solved.withColumn("block", cut)
    parts = sliced.groupBy("season", "block").cogroup(spread.groupBy("season", "block")).applyInPandas(lambda a, b: load(a, b) if len(a) and len(b) else pd.DataFrame({"season": [], "block": [], "mode": [], "value": [], "total": [], "part": []}), "season int, block int, mode int, value double, total double, part array<double>")
    return out.unionByName(parts.groupBy("season").applyInPandas(joined, MODES))


def save(model: DataFrame, path: str) -> None:
    """Stores fitted modes; ``load`` returns them."""
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODES).parquet(path)


def project(days: DataFrame, model: DataFrame, scaling: int = 1, d: str = "d") -> DataFrame:
    """Components pc_0 .. of every day on the modes: raw (0), over (1) or times (2) the root of the eigenvalue."""
    if scaling not in (0, 1, 2):
        raise ValueError("scaling is 0, 1 or 2")
    modes = model.groupBy("season").agg(F.sort_array(F.collect_list(F.struct("mode", "eigenvalue", "loading"))).alias("m"))  # seasons x modes rows
    n = model.agg(F.max("mode")).first()[0]
    dot = lambda m: F.aggregate(F.zip_with("x", m["loading"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    root = lambda m: F.sqrt(m["eigenvalue"])
    scaled = {0: dot, 1: lambda m: F.try_divide(dot(m), F.when(root(m) > 0, root(m))), 2: lambda m: dot(m) * root(m)}[scaling]
    out = days.join(F.broadcast(modes), "season").withColumn("p", F.transform("m", scaled))
    return out.select("season", d, *(F.get("p", F.lit(i)).alias(f"pc_{i}") for i in range((n if n is not None else -1) + 1)))
