"""Forecast metrics as aggregate expressions over (truth, prediction) columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mae(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def mse(y, p) -> Column:
    return F.avg(F.pow(_c(y) - _c(p), 2))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def wmape(y, p) -> Column:
    """Sum of absolute errors over the sum of absolute truths."""
    return F.sum(F.abs(_c(y) - _c(p))) / F.nullif(F.sum(F.abs(_c(y))), F.lit(0.0))


def mape(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)) / F.greatest(F.abs(_c(y)), F.lit(2.220446049250313e-16)))


def max_error(y, p) -> Column:
    return F.max(F.abs(_c(y) - _c(p)))


def r2(y, p) -> Column:
    """1 - squared errors over the truth's squared deviations."""
    n = F.count(_c(y))
    return 1 - F.sum(F.pow(_c(y) - _c(p), 2)) / F.nullif(F.var_pop(_c(y)) * n, F.lit(0.0))


def coverage(y, low, high) -> Column:
    """Share of truths within the interval, ends included."""
    return F.avg(_c(y).between(_c(low), _c(high)).cast("double"))


METRICS: dict[str, Callable[..., Column]] = {"mae": mae, "mse": mse, "rmse": rmse, "wmape": wmape, "mape": mape, "max_error": max_error, "r2": r2}


def r2_of_windows(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean over rows of the r2 within each row's arrays."""
    from .arrays import mean, total

    m = mean(F.col(y))
    errors = total(F.zip_with(y, p, lambda a, b: (a - b) * (a - b)))
    spread = total(F.transform(y, lambda v: (v - m) * (v - m)))
    return df.select((1 - errors / F.nullif(spread, F.lit(0.0))).alias("r2")).agg(F.avg("r2").alias("r2"))


def leaderboard_pivot(scores: DataFrame, index: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A row per index value and a column per name."""
    return scores.groupBy(index).pivot(columns, names).agg(F.first(value))
