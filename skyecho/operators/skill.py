"""Verification of reconstructed series against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyecho.functions.values import clean_rows, percentile_of_score
from skyecho.semantics import REFERENCE, is_reference

SENTINEL = 9999.0


def bias(obs: Column, sim: Column, mode: str = REFERENCE) -> Column:
    """Mean of observed less simulated in ``reference`` mode, the other way round in ``standard`` mode."""
    return F.avg(obs - sim) if is_reference(mode) else F.avg(sim - obs)


def mbe(obs: Column, sim: Column) -> Column:
    return F.avg(obs - sim)


def mse(obs: Column, sim: Column) -> Column:
    return F.avg((obs - sim) * (obs - sim))


def rmse(obs: Column, sim: Column) -> Column:
    return F.sqrt(mse(obs, sim))


def correlation(obs: Column, sim: Column) -> Column:
    """Pearson's, over the days that have both."""
    both = obs.isNotNull() & sim.isNotNull()
    return F.corr(F.when(both, obs), F.when(both, sim))


def skill_score_mse(obs: Column, sim: Column, ref: Column) -> Column:
    """1 less the ratio of the mean squared errors, each over its own common days."""
    return F.lit(1.0) - F.try_divide(mse(obs, sim), F.nullif(mse(obs, ref), F.lit(0.0)))


def brier(obs: Column, sim: Column, threshold: float) -> Column:
    """Mean squared difference of the events of reaching the threshold."""
    hit = lambda c: F.when(c >= threshold, 1.0).when(c < threshold, 0.0)
    return F.avg((hit(sim) - hit(obs)) * (hit(sim) - hit(obs)))


def contingency(obs: Column, sim: Column, threshold: float) -> dict[str, Column]:
    """tp, tn, fp and fn as aggregates."""
    o, s = obs >= threshold, sim >= threshold
    both = obs.isNotNull() & sim.isNotNull()
    return {"tp": F.count_if(both & o & s), "tn": F.count_if(both & ~o & ~s), "fp": F.count_if(both & ~o & s), "fn": F.count_if(both & o & ~s)}


def accuracy(obs: Column, sim: Column, threshold: float) -> Column:
    t = contingency(obs, sim, threshold)
    return F.try_divide((t["tp"] + t["tn"]).cast("double"), t["tp"] + t["tn"] + t["fp"] + t["fn"])


def hss(obs: Column, sim: Column, ref: Column | None, threshold: float, mode: str = REFERENCE) -> Column:
    """``reference``: gain of accuracy over that of ``ref``, 9999 if that one is perfect; ``standard``: Heidke's
    score against chance."""
    if is_reference(mode):
        if ref is None:
            raise ValueError("a reference model is needed")
        r, r0 = accuracy(obs, sim, threshold), accuracy(obs, ref, threshold)
        return F.when(r0 == 1, SENTINEL).otherwise((r - r0) / F.nullif(1 - r0, F.lit(0.0)))
    t = {k: v.cast("double") for k, v in contingency(obs, sim, threshold).items()}
    over = 2 * (t["tp"] * t["tn"] - t["fp"] * t["fn"])
    under = (t["tp"] + t["fn"]) * (t["fn"] + t["tn"]) + (t["tp"] + t["fp"]) * (t["fp"] + t["tn"])
    return F.try_divide(over, F.nullif(under, F.lit(0.0)))


def contingency_table(pairs: DataFrame, threshold: float, keys: Sequence[str] = ("model",), norm: bool = False) -> DataFrame:
    counts = pairs.groupBy(*keys).agg(*(c.alias(n) for n, c in contingency(F.col("obs"), F.col("sim"), threshold).items()))
    if not norm:
        return counts
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return counts.select(*keys, *(F.try_divide(F.col(n).cast("double"), total).alias(n) for n in ("tp", "tn", "fp", "fn")))


def confusion_matrix(pairs: DataFrame, threshold: float, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Rows of cell (TN, FP, FN, TP), count and percent."""
    wide = contingency_table(pairs, threshold, keys)
    long = wide.unpivot(list(keys), ["tn", "fp", "fn", "tp"], "cell", "n")
    total = F.sum("n").over(Window.partitionBy(*keys))
    return long.select(*keys, "cell", "n", F.try_divide(F.col("n") * 100.0, total).alias("percent"))


def paired(observation: DataFrame, models: DataFrame, reference: str | None = None) -> DataFrame:
    """``model, d, obs, sim[, ref]`` of every simulated day; the observation and the reference model
    meet the models on the day (one row a day each, so no day can be hot)."""
    out = models.select("model", "d", F.col("value").alias("sim")).join(observation.select("d", F.col("value").alias("obs")), "d", "left")
    if reference is not None:
        out = out.join(models.where(F.col("model") == reference).select("d", F.col("value").alias("ref")), "d", "left")
    return out.select("model", "d", "obs", "sim", *(["ref"] if reference is not None else []))


def skill_table(observation: DataFrame, models: DataFrame, reference: str | None = None, threshold: float | None = None, mode: str = REFERENCE) -> DataFrame:
    """A row per model: bias, rmse, r2 (Pearson's r, also as r), std (population), and with a reference ssmse,
    with both hss, with a threshold bs. One aggregation for all of them."""
    obs, sim, ref = F.col("obs"), F.col("sim"), F.col("ref")
    wanted = {"bias": bias(obs, sim, mode), "rmse": rmse(obs, sim), "r": correlation(obs, sim), "r2": correlation(obs, sim), "std": F.stddev_pop(sim)}
    if reference is not None:
        wanted["ssmse"] = skill_score_mse(obs, sim, ref)
        if threshold is not None:
            wanted["hss"] = hss(obs, sim, ref, threshold, mode)
    wanted["bs"] = brier(obs, sim, threshold) if threshold is not None else F.max(F.lit(None).cast("double"))
    return paired(observation, models, reference).groupBy("model").agg(*(c.alias(n) for n, c in wanted.items()))


def taylor_points(observation: DataFrame, models: DataFrame) -> DataFrame:
    """Radius (standard deviation) and angle (arc cosine of the correlation) of each model, with the centred error
    that the diagram's contours show."""
    r = correlation(F.col("obs"), F.col("sim"))
    t = paired(observation, models).groupBy("model").agg(F.stddev_pop("sim").alias("std"), r.alias("r"), F.stddev_pop("obs").alias("ref_std"))
    theta = F.acos(F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(1.0)))
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("ref_std") ** 2 + F.col("std") ** 2 - 2 * F.col("ref_std") * F.col("std") * F.cos(theta)))
    return t.select("model", "std", theta.alias("theta"), error.alias("rms"))


def reference_std(observation: DataFrame) -> DataFrame:
    """One row: ``std_ref``, the sample standard deviation of the observed values."""
    return observation.agg(F.stddev_samp(F.col("value").cast("double")).alias("std_ref"))


def equivalent_quantiles(pairs: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """``quantile, predicted, observed``: both series of common days by percentile of score, equal percentiles
    once, matched where they agree and kept where they don't."""
    both = clean_rows(pairs, ["obs", "sim"])

    def side(name: str, out: str) -> DataFrame:
        # Equal percentiles come from equal values, so grouping by the value leaves one of each.
        ranked = both.select(*keys, F.col(name).alias(out), percentile_of_score(F.col(name), keys).alias("quantile"))
        return ranked.groupBy(*keys, out).agg(F.round(F.first("quantile"), 9).alias("quantile"))

    return side("sim", "predicted").join(side("obs", "observed"), [*keys, "quantile"], "full")


class Skill:
    """Observations, reconstructions and reanalysis in one long table: d, role, model, value."""

    def __init__(self, observations: DataFrame | None = None, reconstructions: DataFrame | None = None, reanalysis: DataFrame | None = None, data: DataFrame | None = None) -> None:
        parts = [] if data is None else [data]
        for role, df in (("observation", observations), ("reconstruction", reconstructions), ("reanalysis", reanalysis)):
            if df is not None:
                model = F.col("model") if "model" in df.columns else F.lit(role)
                parts.append(df.select("d", F.lit(role).alias("role"), model.alias("model"), F.col("value").cast("double").alias("value")))
        if not parts:
            raise ValueError("nothing to verify")
        self.data = parts[0]
        for p in parts[1:]:
            self.data = self.data.unionByName(p)

    def _role(self, *roles: str) -> DataFrame:
        return self.data.where(F.col("role").isin(*roles))

    def resample(self, freq: str, grouping: str, hydroyear: bool = False, skipna: bool = False, mode: str = REFERENCE) -> Skill:
        from skyecho.operators.resample import resample

        if grouping not in ("mean", "median", "sum"):
            raise ValueError(f"grouping {grouping} does not exist")
        unit = "1H" if hydroyear and freq.upper().endswith("Y") else freq
        return Skill(data=resample(self.data, grouping, unit, ("role", "model"), d="d", skipna=skipna, mode=mode, out="d"))

    def skill(self, reference: str | None = None, threshold: float | None = None, mode: str = REFERENCE) -> DataFrame:
        return skill_table(self._role("observation"), self._role("reconstruction", "reanalysis"), reference, threshold, mode)

    def reference_std(self) -> DataFrame:
        return reference_std(self._role("observation"))

    def taylor(self) -> DataFrame:
        return taylor_points(self._role("observation"), self._role("reconstruction", "reanalysis"))

    def qqplot(self) -> DataFrame:
        return equivalent_quantiles(paired(self._role("observation"), self._role("reconstruction", "reanalysis")))

    def annual_cycle(self, grouping: str = "mean") -> DataFrame:
        from skyecho.operators.resample import annual_cycle

        return annual_cycle(self.data, grouping, ("role", "model"))

    def series(self) -> DataFrame:
        return self.data
