"""Forecast strategies that are plain expressions over a window array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..series import SeriesSpec
from .grid import future_index
from .windows import supervised_windows, tail


def context(df: DataFrame, spec: SeriesSpec, lags: int) -> DataFrame:
    """(keys, x): each series' last ``lags`` values in order."""
    rows = tail(df, spec, lags).groupBy(*spec.keys).agg(F.array_sort(F.collect_list(F.struct(spec.time, spec.target))).alias("s"))
    return rows.select(*spec.keys, F.transform("s", lambda s: s[spec.target]).alias("x"))


def naive(x: Column) -> Callable[[Column], Column]:
    return lambda h: F.element_at(x, -1)


def seasonal_naive(x: Column, period: int) -> Callable[[Column], Column]:
    """The value a whole number of periods before; needs a window of at least a period."""
    return lambda h: F.get(x, (F.size(x) - period + (h - 1) % period).cast("int"))


def recursive(x: Column, n: int, step: Callable[[Column], Column]) -> Column:
    """n steps of a one-step rule: predict, append, drop the oldest, repeat."""
    w = F.size(x)
    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(n)), x, lambda acc, _: F.concat(acc, F.array(step(F.slice(acc, -w, w)))))
    return F.slice(rolled, w + 1, n)


def moving_average_step(k: int) -> Callable[[Column], Column]:
    return lambda acc: arrays.mean(F.slice(acc, -k, k))


def expand(forecasts: DataFrame, spec: SeriesSpec, df: DataFrame, n: int, array: str = "f") -> DataFrame:
    """(keys, horizon, time, target) from a forecast array per series and the series' last time."""
    ahead = future_index(df, spec, n)
    joined = ahead.join(forecasts, list(spec.keys)) if spec.keys else ahead.crossJoin(F.broadcast(forecasts))  # one row without keys
    return joined.select(*spec.keys, "horizon", spec.time, F.get(array, F.col("horizon") - 1).alias(spec.target))


def direct_lines(df: DataFrame, spec: SeriesSpec, horizon: int) -> DataFrame:
    """(keys, horizon, slope, intercept): one least-squares line per horizon, from a value to the value h later."""
    windows = supervised_windows(df, spec, 1, horizon)
    long = windows.select(*spec.keys, F.col("x")[0].alias("x0"), F.posexplode("y").alias("p", "v"))
    return long.groupBy(*spec.keys, (F.col("p") + 1).alias("horizon")).agg(F.regr_slope("v", "x0").alias("slope"), F.regr_intercept("v", "x0").alias("intercept"))


def ar1(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(keys, slope, intercept, last)."""
    rows = df.withColumn("__p", F.lag(spec.target).over(spec.ordered()))
    return rows.groupBy(*spec.keys).agg(F.regr_slope(spec.target, "__p").alias("slope"), F.regr_intercept(spec.target, "__p").alias("intercept"), F.max_by(spec.target, spec.time).alias("last"))


