"""Statistics of an array column, as expressions. All but the spectrum and correlations, which numpy has fast ways for, stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def std_pop(x: Column) -> Column:
    m = mean(x)
    return F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    s = F.array_sort(x)
    h = (F.size(x) - 1) * F.lit(float(q))
    low = F.floor(h).cast("int")
    below = F.get(s, low)
    return below + (h - low) * (F.get(s, F.ceil(h).cast("int")) - below)


def entropy2(x: Column) -> Column:
    """Shannon entropy to base 2 of x / sum(x); null for negative values or a zero sum."""
    s = total(x)
    parts = F.transform(x, lambda v: F.when(v > 0, -(v / s) * F.log2(v / s)).otherwise(F.lit(0.0)))
    return F.when((F.array_min(x) >= 0) & (s > 0), total(parts))


def diff(x: Column, n: int = 1) -> Column:
    for _ in range(n):
        n = F.greatest(F.size(x) - 1, F.lit(0))
        x = F.zip_with(F.slice(x, 2, n), F.slice(x, 1, n), lambda a, b: a - b)
    return x


def absolute(x: Column) -> Column:
    return F.transform(x, lambda v: F.abs(v))


def moving_average(x: Column, w: int) -> Column:
    """Means of w neighbours; w - 1 fewer values."""
    means = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - (w - 1), F.lit(1))), lambda i: total(F.slice(x, i, F.lit(w))) / F.lit(w))
    return F.when(F.size(x) >= w, means).otherwise(F.array().cast("array<double>"))


def moving_average_padded(x: Column, w: int) -> Column:
    """The moving-average layer: the first mean stands twice."""
    m = moving_average(x, w)
    return F.concat(F.slice(m, 1, 1), m)


def evens(x: Column) -> Column:
    return F.filter(x, lambda v, i: i % 2 == 0)


def odds(x: Column) -> Column:
    return F.filter(x, lambda v, i: i % 2 == 1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once, which inside of lambdas nothing else ensures."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _by_matrix(function, *columns: Column) -> Column:
    """An array from arrays, by a function from matrices to a matrix; rows of equal lengths go through it together. Null where any is null or empty, or holds a null."""

    @pandas_udf("array<double>")
    def run(*some: pd.Series) -> pd.Series:
        out = np.full(len(some[0]), None, object)
        lengths = [np.array([-1 if v is None else len(v) for v in s]) for s in some]
        whole = np.logical_and.reduce([n > 0 for n in lengths])
        for shape in {*zip(*(n[whole].tolist() for n in lengths), strict=True)}:
            at = np.flatnonzero(whole & np.logical_and.reduce([n == k for n, k in zip(lengths, shape, strict=True)]))
            rows = [np.array([s.iat[i] for i in at], np.float64) for s in some]
            found = function(*rows)
            for i, row in zip(at, found, strict=True):
                out[i] = row
        return pd.Series(out)

    return run(*columns)


def _correlated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = b.shape[1]
    padded = np.pad(a, ((0, 0), (n - 1, n - 1)))
    every = np.einsum("rkn,rn->rk", np.lib.stride_tricks.sliding_window_view(padded, n, axis=1), b)
    start = n - n // 2 - 1
    return every[:, start : start + a.shape[1]]


def correlate_same(x: Column, y: Column) -> Column:
    """Centred cross-correlation as long as x, the longer of the two."""
    return _by_matrix(_correlated, x, y)


def count_below(x: Column, bound: Column) -> Column:
    return F.size(F.filter(x, lambda v: v < bound))


def count_above(x: Column, bound: Column) -> Column:
    return F.size(F.filter(x, lambda v: v > bound))


def _runs(x: Column) -> Column:
    """Where a value differs from the one before it, and the size of x at the end."""
    starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, F.greatest(i - 1, F.lit(0)))))
    return F.when(F.size(x) > 0, F.concat(starts, F.array(F.size(x)))).otherwise(F.array(F.lit(0)))


def _tops(x: Column, runs: Column) -> Column:
    """(v, i) of runs of equal values with lower ones on both sides, at their middle; each run is looked at once."""

    def top(j: Column) -> Column:
        here, after = F.get(runs, j), F.get(runs, j + 1)
        v = F.get(x, here)
        return F.when((v > F.get(x, F.get(runs, j - 1))) & (v > F.get(x, after)), F.struct(v.alias("v"), F.floor((here + after - 1) / 2).cast("int").alias("i")))

    inner = F.when(F.size(runs) > 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size(runs) - 3, F.lit(1))), top))
    return F.filter(F.coalesce(inner, F.array().cast("array<struct<v:double,i:int>>")), lambda p: p.isNotNull())


def peaks(x: Column) -> Column:
    """Interior maxima; a plateau with lower neighbours on both sides counts once."""
    x = x.cast("array<double>")
    return let(x, lambda x: let(_runs(x), lambda runs: F.size(_tops(x, runs))))


def far_peaks(x: Column, distance: int = 150) -> Column:
    """Peaks that are left when the highest come first and each drops those nearer than distance; of equal ones the later comes first.

    A plateau with lower neighbours on both sides lies at its middle.
    """

    def keep(kept: Column, p: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k - p["i"]) < distance)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p["i"])))

    x = x.cast("array<double>")
    return let(x, lambda x: let(_runs(x), lambda runs: F.size(F.aggregate(F.sort_array(_tops(x, runs), asc=False), F.array().cast("array<int>"), keep))))


#: Arrays up to this length have their spectrum by direct sums.
DIRECT = 64


def spectrum(x: Column) -> Column:
    """Amplitudes of the discrete Fourier transform, one per frequency 0 ... n - 1.

    Short arrays are summed in their order, as the sum over x[i] * cos(2 pi k i / n) says, so that SQL's sums have
    the same last bits; a fast transform, which longer ones get, rounds elsewhere.
    """

    def amplitudes(a: np.ndarray) -> np.ndarray:
        n = a.shape[1]
        if n > DIRECT:
            return np.abs(np.fft.fft(a, axis=1))
        real, imaginary = np.zeros(a.shape), np.zeros(a.shape)
        for i in range(n):
            angles = [2 * math.pi * k * i / n for k in range(n)]
            real += a[:, i : i + 1] * np.array([math.cos(t) for t in angles])
            imaginary += a[:, i : i + 1] * np.array([math.sin(t) for t in angles])
        with np.errstate(over="ignore"):
            squares = real * real + imaginary * imaginary
        return np.where((squares > 1e-290) & (squares < np.inf), np.sqrt(squares), np.hypot(real, imaginary))

    return _by_matrix(amplitudes, x)


def frequencies(x: Column, spacing: float = 1.0) -> Column:
    """The frequency of each amplitude of spectrum(x), in cycles by unit of the spacing: 0, 1 / (n d), ..., then the negative ones."""
    n = F.size(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k <= F.floor((n - 1) / 2), k).otherwise(k - n) / (n * F.lit(float(spacing)))))


def spectrum_top(x: Column, k: int, spacing: float = 1.0) -> Column:
    """The k largest amplitudes with their frequencies: structs (amplitude, frequency); of equal amplitudes the greater frequency comes first."""
    both = F.arrays_zip(spectrum(x).alias("amplitude"), frequencies(x, spacing).alias("frequency"))
    return F.slice(F.sort_array(both, asc=False), 1, k)


def largest(x: Column, k: int) -> Column:
    return F.slice(F.sort_array(x, asc=False), 1, k)


def remove_at(x: Column, first: int, last: int | None = None) -> Column:
    """x without the elements first ... last (from 0, inclusive)."""
    last = first if last is None else last
    return F.filter(x, lambda v, i: (i < first) | (i > last))


WINDOW_STATISTICS = (
    "mean", "median", "max", "min", "p25", "p75", "std", "entropy", "mean_diff", "mean_abs_diff", "median_diff", "median_abs_diff",
    "under_p75", "under_p25", "under_p90", "over_p90", "peaks", "far_peaks",
)


def window_statistics(x: Column) -> dict[str, Column]:
    """The scalar statistics of a window, by name."""
    d, p25, p75, p90 = diff(x), quantile(x, 0.25), quantile(x, 0.75), quantile(x, 0.9)
    return {
        "mean": mean(x), "median": quantile(x, 0.5), "max": F.array_max(x), "min": F.array_min(x), "p25": p25, "p75": p75, "std": std_pop(x), "entropy": entropy2(x),
        "mean_diff": mean(d), "mean_abs_diff": mean(absolute(d)), "median_diff": quantile(d, 0.5), "median_abs_diff": quantile(absolute(d), 0.5),
        "under_p75": count_below(x, p75), "under_p25": count_below(x, p25), "under_p90": count_below(x, p90), "over_p90": count_above(x, p90),
        "peaks": peaks(x), "far_peaks": far_peaks(x),
    }
