"""Scalers per series: fit gives a table of parameters, transform and inverse join it.

Order statistics come from a sample sort: the values of each series in ranges that Spark samples, with their
positions (see slices.py). A quantile's knots are the values at positions that follow from the number of rows, so
they are exact and no task holds a series; ranks are positions among the distinct values. Values are placed
between the knots of Gauss ranks by an as-of merge over such ranges, with the nearest knots carried over their ends.
"""

from __future__ import annotations

import json
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.shipping import ship
from ..functions.tables import written
from ..series import SeriesSpec
from .slices import Slices


#: Series with more than this share of all rows, fewer than so many, meet their parameters by broadcast.
LONG = 1000


def _joined(df: DataFrame, params: DataFrame, spec: SeriesSpec) -> DataFrame:
    if spec.keys:
        return df.join(params, list(spec.keys))
    return df.crossJoin(F.broadcast(params))  # without keys the parameters are one row


def _joined_long(df: DataFrame, params: DataFrame, spec: SeriesSpec, rows: str) -> DataFrame:
    """As _joined(), but no task gets all rows of a long series: params tell by ``rows`` how many a series has, and long ones are few."""
    keys = list(spec.keys)
    if not keys:
        return _joined(df, params, spec)
    total = params.agg(F.sum(rows)).first()[0] or 0
    long = F.col(rows) * LONG > total
    hot, cold = params.where(long), params.where(~long)
    others = [c for c in params.columns if c not in keys]
    marked = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    known = marked.where("__hot").drop("__hot")
    return known.unionByName(marked.where("__hot IS NULL").drop("__hot", *others).join(cold, keys))


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], value: str, knots: int) -> DataFrame:
    """(keys, __knots, __rows): the quantiles 0, 1 / (knots - 1), ..., 1 of the known values, linear between order statistics.

    Quantile j lies at position j * (rows - 1) / (knots - 1), so each row says itself of which quantiles it is the
    value below or above; at most two rows a quantile are brought together.
    """
    rows = Slices(df.where(F.col(value).isNotNull()), keys, [value]).numbered("__rn", "__rows")
    steps, rn = F.lit(knots - 1), F.col("__rn")
    last = F.col("__rows") - 1

    def of(position: Column) -> Column:
        """The quantiles whose position is from here to the next row, as an array."""
        up = lambda p: F.floor((p * steps + last - 1) / last).cast("long")
        first, end = up(position), F.least(up(position + 1) - 1, steps.cast("long"))
        return F.when(last == 0, F.sequence(F.lit(0).cast("long"), steps.cast("long"))).when(first <= end, F.sequence(first, end))

    none = F.array().cast("array<long>")
    below = F.transform(F.coalesce(of(rn), none), lambda j: F.struct(j.alias("j"), F.lit(True).alias("below")))
    above = F.transform(F.coalesce(F.when(rn > 0, of(rn - 1)), none), lambda j: F.struct(j.alias("j"), F.lit(False).alias("below")))
    asked = rows.withColumn("__k", F.explode(F.concat(below, above))).select(*keys, "__rows", value, "__k.j", "__k.below")
    side = lambda below: F.max(F.when(F.col("below") == F.lit(below), F.col(value)))
    found = asked.groupBy(*keys, "__rows", "j").agg(side(True).alias("__lo"), side(False).alias("__hi"))
    share = F.pmod(F.col("j") * last, steps) / steps
    found = found.select(*keys, "__rows", "j", F.when(share == 0, F.col("__lo")).otherwise(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * share).alias("v"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"])
    return written(found.groupBy(*keys, "__rows").agg(in_order.alias("__knots")), "quantiles")


def _save(table: DataFrame | None, path: str, options: dict, spec: SeriesSpec) -> None:
    if table is None:
        raise ValueError("fit the scaler first")
    table.write.parquet(f"{path}/table")
    row = json.dumps({"options": options, "spec": spec.__dict__})
    table.sparkSession.createDataFrame([(row,)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def _load(spark: SparkSession, path: str) -> tuple[DataFrame, dict, SeriesSpec]:
    made = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    spec = made["spec"]
    return spark.read.parquet(f"{path}/table"), made["options"], SeriesSpec(tuple(spec["keys"]), spec["time"], spec["target"], tuple(spec["features"]))


class Scaler:
    """min_max, standard or quantile (uniform on 1001 knots, linear between them)."""

    KNOTS = 1001

    def __init__(self, spec: SeriesSpec, name: str = "min_max"):
        if name not in ("min_max", "standard", "quantile"):
            raise ValueError(f"no scaler named {name}")
        self.spec, self.name, self.params = spec, name, None

    def fit(self, df: DataFrame) -> Scaler:
        y = F.col(self.spec.target)
        groups = df.groupBy(*self.spec.keys)
        if self.name == "min_max":
            self.params = groups.agg(F.min(y).alias("__a"), (F.max(y) - F.min(y)).alias("__b"))
        elif self.name == "standard":
            self.params = groups.agg(F.avg(y).alias("__a"), F.stddev_pop(y).alias("__b"))
        else:
            self.params = exact_quantiles(df.select(*self.spec.keys, y.cast("double").alias("__v")), self.spec.keys, "__v", self.KNOTS)
        return self

    def save(self, path: str) -> None:
        """The parameters as a Parquet table and a JSON row."""
        _save(self.params, path, {"name": self.name}, self.spec)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        params, made, spec = _load(spark, path)
        out = cls(spec, made["name"])
        out.params = params
        return out

    def _count(self, knots: Column, test) -> Column:
        """How many of the sorted knots pass a test that the first ones pass, by binary search."""
        powers = [1 << i for i in range(self.KNOTS.bit_length() - 1, -1, -1)]
        more = lambda n, p: F.when((n + p <= self.KNOTS) & test(F.get(knots, n + p - 1)), n + p).otherwise(n)
        return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), more)

    def _quantile(self, y: Column) -> Column:
        """Mean of the positions from the left and the right, so ties get the middle of their range."""
        k, n = F.col("__knots"), self.KNOTS - 1
        below, upto = (self._count(k, test) for test in (lambda v: v < y, lambda v: v <= y))
        low, high = F.get(k, upto - 1), F.get(k, upto)
        inside = F.when(upto > below, (below + upto - 1) / 2.0).otherwise(upto - 1 + (y - low) / (high - low))
        return F.when(y <= F.get(k, F.lit(0)), 0.0).when(y >= F.get(k, F.lit(n)), 1.0).otherwise(inside / n)

    def _with_params(self, df: DataFrame) -> DataFrame:
        return _joined_long(df, self.params, self.spec, "__rows") if self.name == "quantile" else _joined(df, self.params, self.spec)

    def transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        a, b = F.col("__a"), F.col("__b")
        if self.name == "quantile":
            change = self._quantile
        else:
            change = lambda y: F.when(b == 0, y * 0.0).otherwise((y - a) / b)
        out = self._with_params(df)
        return out.withColumns({c: change(F.col(c)) for c in columns or [self.spec.target]}).drop(*[c for c in self.params.columns if c.startswith("__")])

    def inverse(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Back to the original scale; by default every column whose name starts with the target's."""
        columns = columns or [c for c in df.columns if c.startswith(self.spec.target)]
        if self.name == "quantile":
            k, n = F.col("__knots"), self.KNOTS - 1

            def change(y):
                h = F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) * n
                low = F.floor(h).cast("int")
                return F.get(k, low) + (h - low) * (F.get(k, F.ceil(h).cast("int")) - F.get(k, low))
        else:
            change = lambda y: y * F.col("__b") + F.col("__a")
        out = self._with_params(df)
        return out.withColumns({c: change(F.col(c)) for c in columns}).drop(*[c for c in self.params.columns if c.startswith("__")])


def _each(function, values: np.ndarray, good: np.ndarray) -> np.ndarray:
    out = np.full(len(values), np.nan)
    out[good] = np.frompyfunc(function, 1, 1)(values[good]).astype(np.float64)
    return out


@pandas_udf(T.DoubleType())
def erfinv(s: pd.Series) -> pd.Series:
    v = s.to_numpy(np.float64)
    return pd.Series(_each(NormalDist().inv_cdf, (v + 1) / 2, np.abs(v) < 1) / math.sqrt(2))


@pandas_udf(T.DoubleType())
def erf(s: pd.Series) -> pd.Series:
    v = s.to_numpy(np.float64)
    return pd.Series(_each(math.erf, v, ~np.isnan(v)))


class GaussRankScaler:
    """Ranks spread over (-1, 1) and bent to a normal shape; between knots linear, beyond them the end's."""

    def __init__(self, spec: SeriesSpec, epsilon: float = 1e-4):
        self.spec, self.epsilon, self.knots = spec, epsilon, None

    def fit(self, df: DataFrame) -> GaussRankScaler:
        """Knots: (keys, value, score) of the distinct values, by their positions among them."""
        y, keys = self.spec.target, list(self.spec.keys)
        bound = 1.0 - self.epsilon
        values = df.where(F.col(y).isNotNull()).select(*keys, F.col(y).alias("value")).distinct()
        rows = Slices(values, keys, ["value"]).numbered("rank", "__n")
        factor = (F.col("__n") - 1) / 2.0 * bound
        score = F.when(factor == 0, 0.0).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("rank") / factor - bound)))
        self.knots = rows.withColumn("score", score).drop("__n")
        return self

    def save(self, path: str) -> None:
        """The knots as a Parquet table and a JSON row."""
        _save(self.knots, path, {"epsilon": self.epsilon}, self.spec)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GaussRankScaler:
        knots, made, spec = _load(spark, path)
        out = cls(spec, made["epsilon"])
        out.knots = knots
        return out

    def ranks(self, df: DataFrame) -> DataFrame:
        """df with score: its target's place between the knots."""
        return self._between(df, "value", "score", self.spec.target, "score")

    def _between(self, df: DataFrame, x: str, s: str, column: str, name: str) -> DataFrame:
        """Linear interpolation at a column by an as-of merge with the knots: both sorted in ranges, the nearest knots carried."""
        keys = list(self.spec.keys)
        own = df.select(*keys, F.col(column).cast("double").alias("__x"), F.lit(None).cast("double").alias("__s"), F.struct(*df.columns).alias("__row"))
        knots = self.knots.select(*keys, F.col(x).cast("double").alias("__x"), F.col(s).cast("double").alias("__s"))
        merged = own.unionByName(knots, allowMissingColumns=True).withColumn("__own", F.col("__s").isNull())
        found = Slices(merged, keys, ["__x", "__own"]).carried(F.when(~F.col("__own"), F.struct("__x", "__s")))
        # Beyond the ends the end knot's score holds (the callers clip there anyway).
        past, ahead = F.col("__tw_before")["v"], F.col("__tw_after")["v"]
        lo, hi = F.coalesce(past, ahead), F.coalesce(ahead, past)
        line = lo["__s"] + (F.col("__x") - lo["__x"]) * (hi["__s"] - lo["__s"]) / (hi["__x"] - lo["__x"])
        value = F.when(F.col("__x").isNotNull(), F.when((lo["__x"] == hi["__x"]) | (F.col("__x") == lo["__x"]), lo["__s"]).otherwise(line))
        return found.where("__own").select("__row.*", value.alias(name))

    def transform(self, df: DataFrame) -> DataFrame:
        bound = 1.0 - self.epsilon
        scored = self.ranks(ship(df))
        return scored.withColumn(self.spec.target, erfinv(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("score"))))).drop("score")

    def inverse(self, df: DataFrame) -> DataFrame:
        placed = ship(df).withColumn("__score", erf(F.col(self.spec.target)))
        return self._between(placed, "score", "value", "__score", "__value").withColumn(self.spec.target, F.col("__value")).drop("__score", "__value")


def scale_windows(df: DataFrame, column: str) -> DataFrame:
    """Min-max by position over all rows of an array column (a scaler per feature of a window matrix)."""
    long = df.select(F.posexplode(column).alias("__p", "__v"))
    bounds = long.groupBy("__p").agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    arrays = bounds.agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__a", "__b"))), lambda s: F.struct(s["__a"].alias("a"), s["__b"].alias("b"))).alias("__bounds"))
    scaled = F.zip_with(F.col(column), F.col("__bounds"), lambda v, s: F.when(s["b"] == s["a"], 0.0).otherwise((v - s["a"]) / (s["b"] - s["a"])))
    return df.crossJoin(F.broadcast(arrays)).withColumn(column, scaled).drop("__bounds")  # one row of bounds
