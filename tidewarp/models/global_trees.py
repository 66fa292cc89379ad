"""One model over all series by the ML library: trees or a line per horizon, trained on the whole cluster."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators.strategies import context, expand
from ..operators.windows import supervised_windows
from ..series import SeriesSpec

KINDS = {"gbt": GBTRegressor, "random_forest": RandomForestRegressor, "linear": LinearRegression}


@dataclass
class GlobalForecaster:
    """Direct strategy: a regressor per horizon from differenced lags to the change since the last value."""

    kind: str = "gbt"
    lags: int = 7
    horizon: int = 3
    params: dict = field(default_factory=dict)

    def _features(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(arrays.diff(F.col("x")))).withColumn("last", F.element_at("x", -1))

    def fit(self, df: DataFrame, spec: SeriesSpec) -> GlobalForecaster:
        rows = self._features(supervised_windows(df, spec, self.lags, self.horizon)).persist()
        self.models = []
        for h in range(self.horizon):
            train = rows.withColumn("label", F.col("y")[h] - F.col("last")).select("features", "label")
            self.models.append(KINDS[self.kind](**self.params).fit(train))
        rows.unpersist()
        return self

    def predict(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        rows = self._features(context(df, spec, self.lags))
        for h, model in enumerate(self.models):
            rows = model.setPredictionCol(f"p{h}").transform(rows)
        f = rows.select(*spec.keys, F.array(*[F.col(f"p{h}") + F.col("last") for h in range(self.horizon)]).alias("f"))
        return expand(f, spec, df, self.horizon)
