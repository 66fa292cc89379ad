"""A chain of named steps: transformers, then a forecaster.

Validation rows go through the transformers that were fitted to the training rows, never into their fit, and score the forecast on
the original scale. A chain is saved as a folder: tables of its steps' parameters and one JSON row, no pickles.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..models.base import Forecaster, FittedForecaster, load_forecaster
from ..operators import checks, scaling
from ..series import SeriesSpec


class NotFittedError(ValueError):
    """Raised by predict before fit."""


@dataclass
class Chain:
    """All steps but the last have fit(df) and transform(df), and optionally inverse(df); the last is a forecaster."""

    spec: SeriesSpec
    steps: list[tuple[str, object]]
    fitted: FittedForecaster | None = field(default=None, init=False)
    transformed: DataFrame | None = field(default=None, init=False, repr=False)
    scores: DataFrame | None = field(default=None, init=False, repr=False)

    def __post_init__(self):
        names = [n for n, _ in self.steps]
        if len(set(names)) != len(names) or not self.steps:
            raise ValueError("steps need different names")
        if not isinstance(self.steps[-1][1], Forecaster):
            raise TypeError("the last step must be a forecaster")
        for name, step in self.steps[:-1]:
            if not hasattr(step, "fit") or not hasattr(step, "transform"):
                raise TypeError(f"{name} needs fit and transform")

    def fit(self, df: DataFrame, eval_set: DataFrame | None = None) -> Chain:
        """Fit all steps; with eval_set (rows after df's), transformed holds it as the forecaster would see it and scores the errors of forecasting it."""
        given = df
        for _, step in self.steps[:-1]:
            df = step.fit(df).transform(df)
        self.fitted = self.steps[-1][1].fit(df, self.spec)
        self.transformed = self.scores = None
        if eval_set is not None:
            if not checks.train_before_valid(given, eval_set, self.spec).where("NOT ok").isEmpty():
                raise ValueError("validation rows must come after the training rows")
            self.transformed, self.scores = self.transform(eval_set), self.evaluate(eval_set)
        return self

    def evaluate(self, df: DataFrame) -> DataFrame:
        """(keys, n, errors): forecasts at the times of df's rows, which come after the training rows, against its values."""
        spec, keys = self.spec, list(self.spec.keys)
        ahead = self.inverse(self._model().predict(at=df.select(*keys, spec.time))).withColumnRenamed(spec.target, "__f")
        both = df.select(*keys, spec.time, spec.target).join(ahead.select(*keys, spec.time, "__f"), [*keys, spec.time])
        return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(spec.target, "__f").alias(k) for k, f in metrics.METRICS.items()))

    def _model(self) -> FittedForecaster:
        if self.fitted is None:
            raise NotFittedError("fit the chain first")
        return self.fitted

    def inverse(self, df: DataFrame) -> DataFrame:
        """Forecasts back on the original scale."""
        for _, step in reversed(self.steps[:-1]):
            if hasattr(step, "inverse"):
                df = step.inverse(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        return df

    def predict(self, n: int, df: DataFrame | None = None) -> DataFrame:
        fitted = self._model()
        return self.inverse(fitted.predict(n) if df is None else fitted.predict_from(self.transform(df), n))

    def save(self, path: str) -> None:
        """All fitted steps below path; steps other than this package's scalers are an error."""
        fitted, rows = self._model(), []
        for i, (name, step) in enumerate(self.steps[:-1]):
            if not hasattr(step, "save"):
                raise TypeError(f"{name} can't be saved")
            step.save(f"{path}/step-{i}")
            rows.append([name, type(step).__name__])
        fitted.save(f"{path}/model")
        row = json.dumps({"steps": rows, "model": self.steps[-1][0]})
        fitted.states.sparkSession.createDataFrame([(row,)], "manifest string").coalesce(1).write.text(f"{path}/chain")

    def __getitem__(self, name: str) -> object:
        return dict(self.steps)[name]


def load_chain(spark: SparkSession, path: str) -> Chain:
    """A chain that save() wrote."""
    made = json.loads(spark.read.text(f"{path}/chain").first()[0])
    kinds = {c.__name__: c for c in (scaling.Scaler, scaling.GaussRankScaler)}
    fitted = load_forecaster(spark, f"{path}/model")
    steps = [(name, kinds[kind].load(spark, f"{path}/step-{i}")) for i, (name, kind) in enumerate(made["steps"])]
    chain = Chain(fitted.spec, [*steps, (made["model"], fitted.model)])
    chain.fitted = fitted
    return chain
