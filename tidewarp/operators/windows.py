"""Windows, splits, differences and smoothing over series.

Series are cut in time slices (see slices.py), so a series of any length is worked on by many tasks; windows
that reach over a block's end find the rows they need in its halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import arrays
from ..series import SeriesSpec
from .slices import Slices, own_rows


def _frame(over: WindowSpec, column: str, first: int, last: int):
    """Values of positions first ... last from here; nulls keep their place."""
    return F.transform(F.collect_list(F.struct(F.col(column).alias("v"))).over(over.rowsBetween(first, last)), lambda s: s["v"])


def supervised_windows(df: DataFrame, spec: SeriesSpec, window: int, horizon: int, step: int = 1) -> DataFrame:
    """(keys, start, x, y): window i has x = values i*step ... of length window and y the horizon values after."""
    if window < 1 or horizon < 1 or step < 1:
        raise ValueError("window, horizon and step must be positive")
    rows, over = Slices.of(df.select(*spec.columns()), spec).blocks(after=window + horizon - 1)
    rows = rows.withColumns({"x": _frame(over, spec.target, 0, window - 1), "y": _frame(over, spec.target, window, window + horizon - 1)})
    whole = F.col("__tw_own") & (F.col("__tw_rn") + (window + horizon) <= F.col("__tw_total")) & (F.col("__tw_rn") % step == 0)
    return rows.where(whole).select(*spec.keys, F.col("__tw_rn").cast("int").alias("start"), "x", "y")


def lag_windows(df: DataFrame, spec: SeriesSpec, window: int, step: int = 1, horizon: int = 1) -> DataFrame:
    """(keys, row, start, x): inference windows; each start is used ``horizon`` times and jumps by horizon * step."""
    if window < 1 or horizon < 1 or step < 1:
        raise ValueError("window, horizon and step must be positive")
    rows, over = Slices.of(df.select(*spec.columns()), spec).blocks(after=window - 1)
    rows = rows.withColumn("x", _frame(over, spec.target, 0, window - 1)).withColumn("start", F.col("__tw_rn").cast("int"))
    rows = rows.where(F.col("__tw_own") & (F.col("start") + window <= F.col("__tw_total")) & (F.col("start") % (step * horizon) == 0))
    first = (F.col("start") / step).cast("int")
    repeated = rows.withColumn("row", F.explode(F.sequence(first, first + horizon - 1))).where(F.col("row") < F.col("__tw_total"))
    return repeated.select(*spec.keys, "row", "start", "x")


def ordered_split(df: DataFrame, spec: SeriesSpec, fraction: float) -> DataFrame:
    """df with part = train for the first floor(fraction * n) rows of a series, else test."""
    rows = Slices.of(df, spec).numbered("__tw_rn", "__tw_total")
    cut = F.floor(F.col("__tw_total") * F.lit(float(fraction)))
    return rows.withColumn("part", F.when(F.col("__tw_rn") < cut, "train").otherwise("test")).drop("__tw_rn", "__tw_total")


def tail(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The last k rows of each series; the rank limit runs before the shuffle."""
    last = spec.whole().orderBy(F.col(spec.time).desc())
    return df.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= k).drop("__r")


def head(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(spec.ordered())).where(F.col("__r") <= k).drop("__r")


def difference(df: DataFrame, spec: SeriesSpec, name: str = "diff", lag: int = 1) -> DataFrame:
    rows, over = Slices.of(df, spec).blocks(before=lag)
    return own_rows(rows.withColumn(name, F.col(spec.target) - F.lag(spec.target, lag).over(over)))


def moving_average(df: DataFrame, spec: SeriesSpec, window: int = 3, name: str = "moving_average") -> DataFrame:
    """Rolling mean; the first window - 1 rows of a series are dropped."""
    rows, over = Slices.of(df, spec).blocks(before=window - 1)
    return own_rows(rows.withColumn(name, F.avg(spec.target).over(over.rowsBetween(-(window - 1), 0))).where(F.col("__tw_rn") >= window - 1))


def last_features(df: DataFrame, spec: SeriesSpec, window: int, columns: list[str]) -> DataFrame:
    """(keys, start, columns): of each window only the features at its last row."""
    rows = Slices.of(df, spec).numbered("__tw_rn").where(F.col("__tw_rn") >= window - 1)
    return rows.select(*spec.keys, (F.col("__tw_rn") - (window - 1)).cast("int").alias("start"), *columns)


def wide_features(df: DataFrame, spec: SeriesSpec, window: int, horizon: int, differences: int = 1, smoothing: int = 2) -> DataFrame:
    """Supervised windows with differenced and smoothed lags and the window statistics as columns."""
    rows = supervised_windows(df, spec, window, horizon)
    lags = F.col("x") if differences == 0 else arrays.diff(F.col("x"), differences)
    lags = lags if smoothing < 2 else arrays.moving_average(lags, smoothing)
    stats = {f"stat_{k}": v for k, v in arrays.window_statistics(F.col("x")).items()}
    more = {"autocorrelation": arrays.correlate_same(F.col("x"), F.col("x")), "diff_correlation": arrays.correlate_same(F.col("x"), arrays.diff(F.col("x")))}
    return rows.withColumns({"lags": lags, **stats, **more})
