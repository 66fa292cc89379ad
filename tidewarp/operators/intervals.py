"""Relative forecast intervals: an error from resampled residuals, applied around the forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..series import SeriesSpec


def interval_error(scored: DataFrame, spec: SeriesSpec, quantile: float = 0.9, compat: bool = False, truth: str = "y", prediction: str = "y_hat", split: str = "split") -> DataFrame:
    """(keys, error): the quantile over splits of each split's wmape. ``compat`` reads the quantile as a percent."""
    per = scored.groupBy(*spec.keys, split).agg(metrics.wmape(truth, prediction).alias("w"))
    q = quantile / 100 if compat else quantile
    return per.groupBy(*spec.keys).agg(F.percentile("w", F.lit(q)).alias("error"))


def apply_interval(forecast: DataFrame, spec: SeriesSpec, errors: DataFrame | float, prediction: str | None = None) -> DataFrame:
    """forecast with <target>_lower and <target>_upper = forecast * (1 -/+ error); they swap below zero."""
    y = prediction or spec.target
    if isinstance(errors, int | float):
        out = forecast.withColumn("error", F.lit(float(errors)))
    elif spec.keys:
        out = forecast.join(errors, list(spec.keys))
    else:
        out = forecast.crossJoin(F.broadcast(errors))  # without keys the errors are one row
    return out.withColumns({f"{spec.target}_lower": F.col(y) * (1 - F.col("error")), f"{spec.target}_upper": F.col(y) * (1 + F.col("error"))}).drop("error")


def chosen_columns(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Keys, time, target and interval columns if all are there; else time first and the rest after."""
    full = [*spec.keys, spec.time, spec.target, f"{spec.target}_lower", f"{spec.target}_upper"]
    if set(full) <= set(df.columns):
        return df.select(*full)
    front = [*spec.keys, spec.time]
    return df.select(*front, *[c for c in df.columns if c not in front])


def rename_quantiles(df: DataFrame, spec: SeriesSpec, low: float, high: float) -> DataFrame:
    """<target>_q0.50 to target, the low and high quantile columns to _lower and _upper."""
    names = {f"{spec.target}_q0.50": spec.target, f"{spec.target}_q{low:.2f}": f"{spec.target}_lower", f"{spec.target}_q{high:.2f}": f"{spec.target}_upper"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def rename_additive(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """ds, yhat, yhat_lower, yhat_upper to the series' own names."""
    names = {"ds": spec.time, "yhat": spec.target, "yhat_lower": f"{spec.target}_lower", "yhat_upper": f"{spec.target}_upper"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
