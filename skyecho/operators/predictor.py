"""A gridded predictor: anomalies, components and their projection in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyecho.functions.calendar import WHOLE_YEAR
from skyecho.operators import grid, pca
from skyecho.semantics import REFERENCE


class Predictor:
    """A daily field (d, latitude, longitude, value) and the seasons it is taken by."""

    def __init__(self, field: DataFrame, seasons: Sequence[Sequence[int]] = WHOLE_YEAR, standardize: bool = True, mode: str = REFERENCE) -> None:
        self.field, self.seasons, self.standardize, self.mode = field, seasons, standardize, mode
        #: The modes of the last fit, or of a stored one.
        self.model: DataFrame | None = None

    def _within(self, period: tuple[object, object] | None) -> DataFrame:
        return self.field if period is None else self.field.where(F.col("d").between(*map(F.lit, period)))

    def fit(self, npcs: int = 4, training: tuple[object, object] | None = None) -> DataFrame:
        """The modes of the days of ``training`` (first and last day; None: all)."""
        days = pca.complete_days(grid.anomalies(self._within(training), self.seasons, self.standardize, mode=self.mode))
        self.model = pca.fit(days, npcs)
        return self.model

    def pcs(self, npcs: int = 4, scaling: int = 1, training: tuple[object, object] | None = None, project: DataFrame | None = None) -> DataFrame:
        """``season, d, pc_0 ..`` of the days of ``training`` (None: all), of all other days of the field on the modes of
        those, and with ``project`` of another field's days in place of both. Modes that were fitted or loaded are used again."""
        model = self.model if self.model is not None else self.fit(npcs, training)
        base = self._within(training)
        own = pca.complete_days(grid.anomalies(base, self.seasons, self.standardize, mode=self.mode))
        shifted = lambda other: pca.project(pca.complete_days(grid.anomalies(other, self.seasons, self.standardize, base=base, mode=self.mode)), model, scaling)
        if project is not None:
            return shifted(project)
        out = pca.project(own, model, scaling)
        if training is None:
            return out
        rest = self.field.where(~F.col("d").between(*map(F.lit, training)))
        return out.unionByName(shifted(rest))

    def save(self, path: str) -> None:
        """Stores the modes, fitting them first if need be."""
        pca.save(self.model if self.model is not None else self.fit(), path)

    def load(self, path: str) -> Predictor:
        """Takes stored modes in place of a fit."""
        self.model = pca.load(self.field.sparkSession, path)
        return self
