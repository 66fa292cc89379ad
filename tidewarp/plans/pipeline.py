"""The model pipeline: hold out each series' tail, scale, train several models, score, rank, forecast."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..models.base import FittedForecaster
from ..models.registry import MODELS, make, model_names
from ..operators import checks, intervals, resample, scaling
from ..series import SeriesSpec, numbered, require_time
from .configs import PipelineConfigs
from .leaderboard import best, ranked


def holdout(df: DataFrame, spec: SeriesSpec, n: int) -> tuple[DataFrame, DataFrame]:
    """All but the last n rows of each series, and those."""
    rows = numbered(df, spec, "__rn").withColumn("__n", F.count(F.lit(1)).over(spec.whole()))
    last = F.col("__rn") >= F.col("__n") - n
    return rows.where(~last).drop("__rn", "__n"), rows.where(last).drop("__rn", "__n")


@dataclass
class ModelPipeline:
    """Parameters for all models go in ``params``; ``name__param`` is for one model; configs come before both."""

    spec: SeriesSpec
    lags: int
    include: str | list | None = "light"
    exclude: list | None = None
    metric: str = "mae"
    metric_less_is_better: bool = True
    scaler: str | None = "min_max"
    quantile: float | None = None
    cv: int = 5
    configs: PipelineConfigs | None = None
    seed: int = 0
    params: dict = field(default_factory=dict)
    models: dict[str, FittedForecaster] = field(default_factory=dict, init=False)
    leaderboard: DataFrame | None = field(default=None, init=False)
    predict_options: dict = field(default_factory=dict, init=False)
    _held: list = field(default_factory=list, init=False, repr=False)

    def __post_init__(self):
        if self.metric not in metrics.METRICS:
            raise KeyError(f"no metric named {self.metric}")
        for k in self.params:
            if "__" in k and k.split("__")[0] not in MODELS:
                raise KeyError(f"no model named {k.split('__')[0]}")

    @staticmethod
    def list_all_available_models() -> list[str]:
        return sorted(MODELS)

    def plan(self) -> list[tuple[str, str, dict]]:
        """(alias, name, parameters) in training order."""
        common = {"lags": self.lags, "seed": self.seed} | {k: v for k, v in self.params.items() if "__" not in k}
        own = lambda name: {k.split("__", 1)[1]: v for k, v in self.params.items() if k.startswith(f"{name}__")}
        if self.configs:
            made = [(a, n, common | own(n) | o["init_configs"] | o["fit_configs"]) for a, n, o in self.configs.entries]
            return sorted(made, key=lambda x: x[:2])
        return [(n, n, common | own(n)) for n in model_names(self.include, self.exclude)]

    def _options(self, alias: str) -> dict:
        """What replaces a model's parameters while it forecasts."""
        return self.configs.get_configs(alias)["predict_configs"] if self.configs else self.predict_options.get(alias, {})

    def unpersist(self) -> None:
        """Release what fit() holds in memory; forecasts are still possible, at the price of training again."""
        for df in self._held:
            df.unpersist()
        self._held = []

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist())
        return df

    def _error(self, alias: str, name: str, params: dict, train: DataFrame) -> DataFrame:
        """(keys, error) from block resamples: train on the drawn blocks in their order, test on what was not drawn."""
        return intervals.interval_error(self._resampled(name, params, train), self.spec, self.quantile, truth=self.spec.target)

    def _resampled(self, name: str, params: dict, train: DataFrame) -> DataFrame:
        """(keys, split, horizon, target, y_hat): each row that a split did not draw, with its forecast at its own time; there are as many steps as such rows."""
        spec = self.spec
        drawn, rest = resample.block_bootstrap(train, spec, self.lags, self.cv)
        resampled = SeriesSpec((*spec.keys, "split"), spec.time, spec.target, spec.features)
        fitted = make(name, **params).fit(drawn, resampled, order="pos")
        ahead = fitted.predict(at=rest).withColumnRenamed(spec.target, "y_hat")
        truth = numbered(rest, resampled, "horizon").withColumn("horizon", F.col("horizon") + 1)
        return truth.join(ahead.select(*spec.keys, "split", "horizon", "y_hat"), [*spec.keys, "split", "horizon"])

    def fit(self, df: DataFrame, valid: DataFrame | None = None, valid_rows: int | None = None) -> DataFrame:
        """Train and score all models; returns the leaderboard (keys, model, metric, train_cost, eval_cost, rank)."""
        spec = self.spec
        self.unpersist()
        self.models = {}
        require_time(df, spec)
        if valid is None:
            df, valid = holdout(df, spec, valid_rows or self.lags)
        elif sorted(df.columns) != sorted(valid.columns):
            raise ValueError("training and validation rows need the same columns")
        elif not checks.train_before_valid(df, valid, spec).where("NOT ok").isEmpty():
            raise ValueError("validation rows must come after the training rows")
        self.scale = scaling.Scaler(spec, self.scaler).fit(df) if self.scaler else None
        train = self.scale.transform(df) if self.scale else df
        steps = valid.groupBy(*spec.keys).count().agg(F.max("count")).first()[0] or 0
        scores, truth = None, valid.select(*spec.keys, spec.time, F.col(spec.target).alias("__truth"))
        for alias, name, params in self.plan():
            began = time.time()
            fitted = make(name, **params).fit(train, spec)
            fitted.states = self._hold(fitted.states)
            fitted.states.count()
            self.models[alias], cost = fitted, time.time() - began
            began = time.time()
            ahead = self._forecast(alias, fitted, name, params, train, steps)
            joined = ahead.join(truth, [*spec.keys, spec.time])
            columns: dict[str, Column] = {self.metric: metrics.METRICS[self.metric]("__truth", spec.target)}
            if self.quantile:
                columns["quantile_acc"] = metrics.coverage("__truth", f"{spec.target}_lower", f"{spec.target}_upper")
            score = joined.groupBy(*spec.keys).agg(*[c.alias(k) for k, c in columns.items()]).withColumn("model", F.lit(alias))
            score = self._hold(score.withColumn("train_cost", F.lit(round(cost, 3))))
            score.count()
            score = score.withColumn("eval_cost", F.lit(round(time.time() - began, 3)))
            scores = score if scores is None else scores.unionByName(score)
        self.leaderboard = ranked(scores, list(spec.keys), self.metric, self.metric_less_is_better)
        return self.leaderboard

    def _forecast(self, alias: str, fitted: FittedForecaster, name: str, params: dict, train: DataFrame | None, n: int) -> DataFrame:
        out = fitted.predict(n, **self._options(alias))
        if self.quantile:
            if not hasattr(fitted, "errors"):
                fitted.errors = self._hold(self._error(alias, name, params, train))
            out = intervals.apply_interval(out, self.spec, fitted.errors)
        return self.scale.inverse(out) if self.scale else out

    def best(self) -> DataFrame:
        return best(self.leaderboard.drop("rank"), list(self.spec.keys), self.metric, self.metric_less_is_better)

    def get_model(self, alias: str | None = None) -> FittedForecaster:
        """By alias, or the model that is best on average."""
        if alias is None:
            rank = self.leaderboard.groupBy("model").agg(F.avg(self.metric).alias("m"))
            order = F.col("m").asc_nulls_last() if self.metric_less_is_better else F.col("m").desc_nulls_last()
            alias = rank.orderBy(order, "model").first()["model"]
        return self.models[alias]

    def get_model_all_configs(self, alias: str | None = None) -> dict:
        return dict(self.get_model(alias).model.__dict__)

    def predict(self, n: int, alias: str | None = None, df: DataFrame | None = None) -> DataFrame:
        """n steps per series from its own best model, or from one model; from the end of df if given."""
        keys = list(self.spec.keys)
        chosen, out = self.best().select(*keys, "model"), None
        for a in [alias] if alias else list(self.models):
            fitted = self.models[a]
            if not alias:
                # Only the series whose best model this is are forecast by it.
                mine = chosen.where(F.col("model") == a)
                states = fitted.states.join(mine.drop("model"), keys, "left_semi") if keys else fitted.states.join(mine.select("model"), F.lit(True), "left_semi")
                errors = getattr(fitted, "errors", None)
                fitted = FittedForecaster(fitted.model, fitted.spec, states)
                fitted.errors = errors
            options = self._options(a)
            part = fitted.predict_from(self.scale.transform(df) if self.scale else df, n, **options) if df is not None else fitted.predict(n, **options)
            if self.quantile:
                part = intervals.apply_interval(part, self.spec, fitted.errors)
            part = part.withColumn("model", F.lit(a))
            out = part if out is None else out.unionByName(part)
        return self.scale.inverse(out) if self.scale else out

    def save(self, path: str) -> None:
        """All models, the leaderboard, the scaler's parameters and a JSON manifest; no pickles."""
        import json

        spark = self.leaderboard.sparkSession
        for alias, fitted in self.models.items():
            fitted.save(f"{path}/models/{alias}")
            if hasattr(fitted, "errors"):
                fitted.errors.write.parquet(f"{path}/errors/{alias}")
        self.leaderboard.write.parquet(f"{path}/leaderboard")
        if self.scale:
            self.scale.params.write.parquet(f"{path}/scaler")
        keep = {k: getattr(self, k) for k in ("lags", "metric", "metric_less_is_better", "scaler", "quantile", "cv", "seed")}
        options = {a: self._options(a) for a in self.models}
        row = json.dumps({"spec": self.spec.__dict__, "aliases": list(self.models), "predict_options": options, **keep})
        spark.createDataFrame([(row,)], "manifest string").coalesce(1).write.text(f"{path}/manifest")

    @classmethod
    def load(cls, spark, path: str) -> ModelPipeline:
        import json

        from ..models.base import load_forecaster

        made = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        spec, aliases, options = made.pop("spec"), made.pop("aliases"), made.pop("predict_options")
        pipe = cls(SeriesSpec(tuple(spec["keys"]), spec["time"], spec["target"], tuple(spec["features"])), include=[], **made)
        pipe.models = {a: load_forecaster(spark, f"{path}/models/{a}") for a in aliases}
        pipe.predict_options = options
        pipe.leaderboard = spark.read.parquet(f"{path}/leaderboard")
        pipe.scale = None
        if pipe.scaler:
            pipe.scale = scaling.Scaler(pipe.spec, pipe.scaler)
            pipe.scale.params = spark.read.parquet(f"{path}/scaler")
        if pipe.quantile:
            for a, fitted in pipe.models.items():
                fitted.errors = spark.read.parquet(f"{path}/errors/{a}")
        return pipe
