"""Direct forecasts by least squares on all lags, from mergeable sums.

The normal equations of a series need only the Gram matrix of its windows: the sums of products of a window's
values (and a constant) with each other and with the values to be forecast. They are plain sums, so map tasks
add up their own windows, wherever a series' slices are, and one row of sums a series is what is shuffled.
The equations of all horizons share their matrix and are solved at once for each series by array expressions:
Gauss-Jordan elimination with the largest pivot.

Defined cases: windows with a null are left out. Columns that add nothing (as of a constant series, or of fewer
windows than unknowns) get the coefficient 0. Series too short for a window have no row. Sums of products are in
double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..series import SeriesSpec
from .strategies import context, expand
from .windows import supervised_windows

#: A pivot of less than this share of its column's largest entry adds nothing.
SINGULAR = 1e-11


def gram(windows: DataFrame, keys: list[str], lags: int, horizon: int) -> DataFrame:
    """(keys, n, system) of windows (keys, x, y): system has a row for the constant and for each lag, with the Gram matrix and then the products with y."""
    x = [F.lit(1.0), *(F.get("x", F.lit(i)) for i in range(lags))]
    y = [F.get("y", F.lit(i)) for i in range(horizon)]
    sums = {f"g{i}_{j}": F.sum(x[i] * x[j]) for i in range(lags + 1) for j in range(i, lags + 1)}
    sums |= {f"h{i}_{j}": F.sum(x[i] * y[j]) for i in range(lags + 1) for j in range(horizon)}
    whole = windows.where(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    found = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(s.alias(k) for k, s in sums.items()))
    rows = [F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(lags + 1)), *(F.col(f"h{i}_{j}") for j in range(horizon))) for i in range(lags + 1)]
    return found.where("n > 0").select(*keys, "n", F.array(*rows).alias("system"))


def solve(system: Column, size: int, ridge: float = 0.0) -> Column:
    """The solutions of a system of ``size`` rows, [matrix | right sides]: an array of rows, one an unknown, of a value for each right side."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    if ridge:
        system = F.transform(system, lambda row, i: F.transform(row, lambda v, j: F.when((i == j) & (i > 0), v + F.lit(float(ridge))).otherwise(v)))
    largest = F.transform(places, lambda k: F.array_max(F.transform(system, lambda row: F.abs(F.get(row, k)))))
    # used[k] is the row that eliminated column k, or -1 where the column adds nothing.
    start = F.struct(system.alias("m"), largest.alias("largest"), F.array().cast("array<int>").alias("used"))

    def step(state: Column, k: Column) -> Column:
        m = state["m"]
        free = F.transform(places, lambda i: F.when(F.array_contains(state["used"], i), F.lit(-1.0)).otherwise(F.abs(F.get(F.get(m, i), k))))
        best = F.array_max(F.arrays_zip(free.alias("size"), F.transform(places, lambda i: -i).alias("place")))

        def eliminate(best: Column) -> Column:
            p = (-best["1"]).cast("int")
            good = best["0"] > F.get(state["largest"], k) * SINGULAR
            pivot = F.transform(F.get(m, p), lambda v: v / F.get(F.get(m, p), k))
            rest = F.transform(m, lambda row, i: F.when(i == p, pivot).otherwise(F.zip_with(row, pivot, lambda a, b: a - F.get(row, k) * b)))
            return F.struct(
                F.when(good, rest).otherwise(m).alias("m"), state["largest"].alias("largest"), F.concat(state["used"], F.array(F.when(good, p).otherwise(F.lit(-1)))).alias("used")
            )

        return let(F.struct(best["size"].alias("0"), best["place"].alias("1")), eliminate)

    def read(done: Column) -> Column:
        width = F.size(F.get(done["m"], F.lit(0))) - size
        nothing = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
        return F.transform(done["used"], lambda p: F.when(p < 0, nothing).otherwise(F.slice(F.get(done["m"], p), size + 1, width)))

    return let(F.aggregate(places, start, step), read)


def direct_regression(df: DataFrame, spec: SeriesSpec, lags: int, horizon: int, ridge: float = 0.0) -> DataFrame:
    """(keys, n, horizon, coefficients): for each step ahead the constant and the weights of the last ``lags`` values, oldest first."""
    keys = list(spec.keys)
    sums = gram(supervised_windows(df, spec, lags, horizon), keys, lags, horizon)
    found = sums.select(*keys, "n", solve(F.col("system"), lags + 1, ridge).alias("s"))
    ahead = found.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(*keys, "n", "horizon", F.transform("s", lambda row: F.get(row, F.col("horizon") - 1)).alias("coefficients"))


def direct_forecast(df: DataFrame, spec: SeriesSpec, lags: int, horizon: int, ridge: float = 0.0) -> DataFrame:
    """(keys, horizon, time, target) by direct_regression() from each series' last values."""
    keys = list(spec.keys)
    fitted = direct_regression(df, spec, lags, horizon, ridge)
    x = context(df, spec, lags)
    both = fitted.join(x, keys) if keys else fitted.crossJoin(F.broadcast(x))  # one window without keys
    value = F.aggregate(F.zip_with(F.col("coefficients"), F.concat(F.array(F.lit(1.0)), F.col("x").cast("array<double>")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    steps = both.select(*keys, "horizon", value.alias("v"))
    f = steps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("horizon", "v"))), lambda s: s["v"]).alias("f"))
    return expand(f, spec, df, horizon)
