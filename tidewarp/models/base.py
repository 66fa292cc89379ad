"""Per-series forecasters: numpy inside a grouped function, state as a table.

A model is fitted for every series at once: ``fit`` returns a table (keys, last_time, step, context, state) whose
state is JSON (arrays as base64), so it can be written, read and joined like any other. ``predict`` maps over that
table. A series' rows must fit in a task, as they do for any per-series solver; there is no limit on the number
of series. A series' step is its commonest gap, in seconds or months, so forecasts of hourly, daily or monthly
series are an hour, a day or a month apart.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, replace
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from ..operators.checks import long_enough
from ..series import SeriesSpec, Step, at_wall_seconds, require_time, wall_seconds


def pack_state(state: dict) -> str:
    def value(x):
        if isinstance(x, np.ndarray):
            return {"__dtype": str(x.dtype), "shape": list(x.shape), "data": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()}
        if isinstance(x, dict):
            return {k: value(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [value(v) for v in x]
        return x.item() if isinstance(x, np.generic) else x

    return json.dumps(value(state))


def unpack_state(text: str) -> dict:
    def value(x):
        if isinstance(x, dict):
            if "__dtype" in x:
                return np.frombuffer(base64.b64decode(x["data"]), x["__dtype"]).reshape(x["shape"]).copy()
            return {k: value(v) for k, v in x.items()}
        return [value(v) for v in x] if isinstance(x, list) else x

    return value(json.loads(text))


def sliding(y: np.ndarray, window: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a series and the values after each."""
    both = np.lib.stride_tricks.sliding_window_view(y, window + horizon)
    return both[:, :window].copy(), both[:, window:].copy()


@dataclass
class Forecaster:
    """What all models share. ``lags`` is both the window and the direct horizon."""

    name: ClassVar[str] = ""
    lags: int = 7
    seed: int = 0

    def fit_values(self, y: np.ndarray, days: np.ndarray) -> dict:
        """State from one series: values in time order and their days since 1970-01-01, with fractions."""
        raise NotImplementedError

    def predict_values(self, state: dict, context: np.ndarray, days: np.ndarray) -> np.ndarray:
        """A value for each of the days ahead."""
        raise NotImplementedError

    # --- tables

    #: Set by models that look at the calendar and the spec's features: fit_wide and predict_wide then take them too.
    wide_inputs: ClassVar[bool] = False

    def inputs(self, df: DataFrame, spec: SeriesSpec, first: Column) -> Column | None:
        """What a row shows beside its value, as an array."""
        return None

    def fit(self, df: DataFrame, spec: SeriesSpec, order: str | None = None) -> FittedForecaster:
        """A state for each series. Its rows are taken by time, or by the column ``order`` (as in resampled series, whose times repeat)."""
        require_time(ship(df), spec)
        df, short = long_enough(df.where(F.col(spec.target).isNotNull()), spec, self.lags)
        keys, kind = list(spec.keys), df.schema[spec.time].dataType
        columns = [F.col(spec.time).alias("__t"), wall_seconds(F.col(spec.time), kind).alias("__w"), F.col(spec.target).cast("double").alias("__y")]
        columns.append(F.col(order).cast("long").alias("__o") if order else columns[1].alias("__o"))
        if self.wide_inputs:
            df = df.withColumn("__first", F.min(spec.time).over(spec.whole()))
            columns += [self.inputs(df, spec, F.col("__first")).alias("__x"), F.col("__first")]
        rows = df.select(*keys, *columns)
        out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("last_time", kind), T.StructField("last_wall", T.LongType()), *STEP, T.StructField("context", T.ArrayType(T.DoubleType())), T.StructField("state", T.StringType())])
        if self.wide_inputs:
            out = out.add("inputs", T.ArrayType(T.DoubleType())).add("first_time", kind)

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__o", kind="stable")
            y, wall = pdf["__y"].to_numpy(np.float64), pdf["__w"].to_numpy(np.int64)
            last, step = pdf.iloc[-1], Step.modal(np.sort(wall))
            row = {k: last[k] for k in keys} | {"last_time": last["__t"], "last_wall": int(wall[-1]), "context": y[-self.lags :].tolist()}
            row |= {"step_months": step.months, "step_seconds": step.seconds, "step_anchor": step.anchor}
            if self.wide_inputs:
                x = np.array(pdf["__x"].tolist(), np.float64)
                state = self.fit_wide(y, x)
                row |= {"inputs": x[-1].tolist(), "first_time": last["__first"]}
            else:
                state = self.fit_values(y, wall / 86400)
            return pd.DataFrame([row | {"state": pack_state(state)}])

        return FittedForecaster(self, spec, rows.groupBy(*keys).applyInPandas(train, out), short)


STEP = [T.StructField("step_months", T.IntegerType()), T.StructField("step_seconds", T.LongType()), T.StructField("step_anchor", T.IntegerType())]


@dataclass
class FittedForecaster:
    model: Forecaster
    spec: SeriesSpec
    states: DataFrame
    short: DataFrame | None = field(default=None, repr=False)

    def _ahead(self, states: DataFrame) -> DataFrame:
        """states (with __n) with walls: the wall seconds of the steps ahead, by the model's freq if it has one."""
        freq = getattr(self.model, "freq", None)
        if freq is not None:
            step = Step.of(freq)
            values = {"step_months": F.lit(step.months), "step_seconds": F.lit(step.seconds).cast("long"), "step_anchor": F.lit(step.anchor)}
            states = states.withColumns(values)
        out = T.StructType([*states.schema.fields, T.StructField("walls", T.ArrayType(T.LongType()))])

        def times(parts):
            for pdf in parts:
                rows = zip(pdf["step_months"], pdf["step_seconds"], pdf["step_anchor"], pdf["last_wall"], pdf["__n"], strict=True)
                yield pdf.assign(walls=[Step(int(m), int(s), int(a)).ahead(int(w), int(n)) for m, s, a, w, n in rows])

        return states.mapInPandas(times, out)

    def _with_future(self, states: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """states with future: what the model's inputs show at the steps ahead; features of the spec are the known ones, or stay as they were last."""
        spec, kind = self.spec, self.states.schema["last_time"].dataType
        steps = states.select(*spec.keys, "first_time", "inputs", F.posexplode("walls").alias("__p", "__w")).withColumn(spec.time, at_wall_seconds(F.col("__w"), kind))
        n = len(spec.features)
        for i, c in enumerate(spec.features):
            steps = steps.withColumn(c, F.get("inputs", F.size("inputs") - (n - i)))
        if known is not None:
            given = [c for c in spec.features if c in known.columns]
            own = known.select(*spec.keys, spec.time, *(F.col(c).cast("double").alias(f"__known_{c}") for c in given))
            steps = steps.join(own, [*spec.keys, spec.time], "left").withColumns({c: F.coalesce(f"__known_{c}", F.col(c).cast("double")) for c in given})
        x = self.model.inputs(steps, spec, F.col("first_time"))
        rows = steps.groupBy(*spec.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", x.alias("x")))), lambda s: s["x"]).alias("future"))
        return states.join(rows, list(spec.keys)) if spec.keys else states.crossJoin(F.broadcast(rows))  # one row each without keys

    def predict(self, n: int | DataFrame | None = None, at: DataFrame | None = None, future: DataFrame | None = None, **options) -> DataFrame:
        """(keys, horizon, time, target): n steps after each series' end; with a table (keys, n), as many as it has for each series.

        ``at`` has the times (keys, time) of the steps themselves, in place of n. ``future`` has what is known of the
        spec's features at them (keys, time, features), once a time; see covariates.known_ahead(). Options replace the model's own
        parameters for this call; unknown ones are an error.
        """
        if options:
            return replace(self, model=replace(self.model, **options)).predict(n, at, future)
        keys, spec, model = list(self.spec.keys), self.spec, self.model
        kind = self.states.schema["last_time"].dataType
        if at is not None:
            wall = F.array_sort(F.collect_list(wall_seconds(F.col(spec.time), at.schema[spec.time].dataType))).alias("walls")
            times = at.groupBy(*keys).agg(wall)
            states = self.states.join(times, keys) if keys else self.states.crossJoin(F.broadcast(times))  # one row each without keys
        elif isinstance(n, DataFrame):
            states = self._ahead(self.states.join(n.withColumnRenamed("n", "__n"), keys))
        else:
            states = self._ahead(self.states.withColumn("__n", F.lit(n)))
        if model.wide_inputs:
            states = self._with_future(states, future)
        out = T.StructType([*[self.states.schema[k] for k in keys], T.StructField("walls", T.ArrayType(T.LongType())), T.StructField("f", T.ArrayType(T.DoubleType()))])

        def forecast(parts):
            for pdf in parts:
                f = []
                for i in range(len(pdf)):
                    r = pdf.iloc[i]
                    state, context = unpack_state(r["state"]), np.asarray(r["context"], np.float64)
                    if model.wide_inputs:
                        values = model.predict_wide(state, context, np.asarray(r["inputs"], np.float64), np.array([*r["future"]], np.float64))
                    else:
                        values = model.predict_values(state, context, np.asarray(r["walls"], np.int64) / 86400)
                    f.append(values.tolist())
                yield pdf[[*keys, "walls"]].assign(f=f)

        rows = states.mapInPandas(forecast, out).select(*keys, "walls", F.posexplode("f").alias("p", spec.target))
        rows = rows.withColumn("horizon", F.col("p") + 1).withColumn(spec.time, at_wall_seconds(F.get("walls", F.col("p")), kind)).select(*keys, "horizon", spec.time, spec.target)
        if getattr(model, "include_history", False):
            rows = self.history().unionByName(rows)
        return rows

    def history(self) -> DataFrame:
        """(keys, horizon, time, target): the model's values at the times that it was fitted to, horizons 0, -1, -2, ... from the last."""
        keys, spec, model = list(self.spec.keys), self.spec, self.model
        kind = self.states.schema["last_time"].dataType
        out = T.StructType([*[self.states.schema[k] for k in keys], T.StructField("horizon", T.IntegerType()), T.StructField("wall", T.LongType()), T.StructField(spec.target, T.DoubleType())])

        def back(parts):
            for pdf in parts:
                for i in range(len(pdf)):
                    r = pdf.iloc[i]
                    state = unpack_state(r["state"])
                    days, values = model.fitted_values(state)
                    yield pd.DataFrame({**{k: [r[k]] * len(days) for k in keys}, "horizon": np.arange(1 - len(days), 1), "wall": np.rint(days * 86400).astype(np.int64), spec.target: values})

        rows = self.states.mapInPandas(back, out)
        return rows.withColumn(spec.time, at_wall_seconds(F.col("wall"), kind)).select(*keys, "horizon", spec.time, spec.target)

    def predict_from(self, df: DataFrame, n: int, **options) -> DataFrame:
        """Forecast from the end of another stretch of the same series."""
        keys, kind = list(self.spec.keys), df.schema[self.spec.time].dataType
        from ..operators.strategies import context

        wall = wall_seconds(F.col(self.spec.time), kind)
        columns = [F.max(self.spec.time).alias("last_time"), F.max(wall).alias("last_wall")]
        kept = [*keys, "step_months", "step_seconds", "step_anchor", "state"]
        if self.model.wide_inputs:
            first = self.states.select(*keys, "first_time")
            df = df.join(first, keys) if keys else df.crossJoin(F.broadcast(first))  # one row without keys
            columns.append(F.max_by(self.model.inputs(df, self.spec, F.col("first_time")), F.col(self.spec.time)).alias("inputs"))
            kept.append("first_time")
        ends = df.groupBy(*keys).agg(*columns)
        x = context(df, self.spec, self.model.lags).withColumnRenamed("x", "context")
        state = self.states.select(*kept)
        joined = ends.join(x, keys).join(state, keys) if keys else ends.crossJoin(F.broadcast(x)).crossJoin(F.broadcast(state))  # one row each without keys
        return FittedForecaster(self.model, self.spec, joined.withColumn("context", F.col("context").cast("array<double>")).select(*self.states.columns)).predict(n, **options)

    def score(self, df: DataFrame) -> DataFrame:
        """(keys, r2): of the direct outputs for all windows of df that have values after them; the mean over windows of each window's r2."""
        keys, spec, model = list(self.spec.keys), self.spec, self.model
        if not isinstance(model, WindowForecaster):
            raise TypeError(f"{model.name} has no windows to be scored")
        rows = df.where(F.col(spec.target).isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(spec.time).alias("t"), F.col(spec.target).cast("double").alias("y")))), lambda s: s["y"]).alias("ys"))
        state = self.states.select(*keys, "state")
        joined = rows.join(state, keys) if keys else rows.crossJoin(F.broadcast(state))  # one row each without keys
        out = T.StructType([*[self.states.schema[k] for k in keys], T.StructField("r2", T.DoubleType())])

        def scored(parts):
            for pdf in parts:
                r2 = []
                for text, ys in zip(pdf["state"], pdf["ys"], strict=True):
                    state, ys = unpack_state(text), np.asarray(ys, np.float64)
                    ahead = model.predict_windows(state, ys[None, : model.lags]).shape[1] if len(ys) >= model.lags else 0
                    if not ahead or len(ys) < model.lags + ahead:
                        r2.append(None)
                        continue
                    x, y = sliding(ys, model.lags, ahead)
                    off, spread = ((y - model.predict_windows(state, x)) ** 2).sum(1), ((y - y.mean(1, keepdims=True)) ** 2).sum(1)
                    r2.append(float(np.mean(np.where(spread > 0, 1 - off / np.where(spread > 0, spread, 1), np.where(off > 0, 0.0, 1.0)))))
                yield pdf[keys].assign(r2=r2)

        return joined.mapInPandas(scored, out)

    def save(self, path: str) -> None:
        """States as Parquet and the model's parameters as one JSON row."""
        self.states.write.parquet(f"{path}/states")
        spark = self.states.sparkSession
        params = {k: v for k, v in self.model.__dict__.items() if isinstance(v, int | float | str | bool | list | tuple | None)}
        row = json.dumps({"name": self.model.name, "params": params, "spec": self.spec.__dict__})
        spark.createDataFrame([(row,)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def load_forecaster(spark: SparkSession, path: str) -> FittedForecaster:
    from .registry import make

    made = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    spec = SeriesSpec(tuple(made["spec"]["keys"]), made["spec"]["time"], made["spec"]["target"], tuple(made["spec"]["features"]))
    return FittedForecaster(make(made["name"], **made["params"]), spec, spark.read.parquet(f"{path}/states"))


@dataclass
class WindowForecaster(Forecaster):
    """A model from a window of ``lags`` values to the ``lags`` values after it."""

    def fit_windows(self, x: np.ndarray, y: np.ndarray) -> dict:
        raise NotImplementedError

    def predict_windows(self, state: dict, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def horizon(self, size: int) -> int:
        return max(1, min(self.lags, size - self.lags))

    def fit_values(self, y: np.ndarray, days: np.ndarray) -> dict:
        x, z = sliding(y, self.lags, self.horizon(len(y)))
        return self.fit_windows(x, z)

    def predict_values(self, state: dict, context: np.ndarray, days: np.ndarray) -> np.ndarray:
        """The direct outputs; beyond them the window moves by one with the first output, and the last output is added."""
        n, x = len(days), context[None, -self.lags :].astype(np.float64)
        out = self.predict_windows(state, x)[0]
        res = out[:n].tolist()
        while len(res) < n:
            x = np.concatenate([x[:, 1:], [[out[0]]]], axis=1)
            out = self.predict_windows(state, x)[0]
            res.append(out[-1])
        return np.asarray(res)
