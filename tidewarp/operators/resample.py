"""Block bootstrap and rolling-origin splits of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..series import SeriesSpec, numbered
from .slices import Slices

#: Fixed values of the generator (multiplier, increment, modulus): small enough for exact long arithmetic anywhere.
A, C, M = 1103515245, 12345, 1 << 31


def draws(split, draw, blocks):
    """Which block a split's draw takes: a linear congruential generator seeded by (split, draw)."""
    seed = split * 1000003 + draw * 7919 + 17
    once = F.pmod(seed * A + C, F.lit(M).cast("long"))
    twice = F.pmod(once * A + C, F.lit(M).cast("long"))
    return F.pmod(F.floor(twice / 1024).cast("long"), blocks)


def block_bootstrap(df: DataFrame, spec: SeriesSpec, length: int, splits: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test) with a split column: train has blocks drawn with replacement (position pos), test the rows not drawn."""
    keys = list(spec.keys)
    rows = numbered(df, spec).withColumn("block", F.floor(F.col("rn") / length).cast("long"))
    blocks = rows.groupBy(*keys).agg((F.max("block") + 1).alias("blocks"))
    drawn = blocks.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))
    drawn = drawn.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    drawn = drawn.withColumn("block", draws(F.col("split"), F.col("draw"), F.col("blocks"))).drop("blocks")
    train = rows.join(drawn, [*keys, "block"])
    train = train.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys, "split").orderBy("draw", "rn")) - 1).cast("int"))
    every = rows.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))
    test = every.join(drawn.select(*keys, "split", "block").distinct(), [*keys, "split", "block"], "left_anti")
    return train.drop("rn"), test


def block_multiplicities(df: DataFrame, spec: SeriesSpec, length: int, splits: int = 5) -> DataFrame:
    """df with times_drawn: for each split how often it draws the row's block. No row is copied.

    A split's resample is the rows with these weights, its test rows those with 0. The draws are those of
    block_bootstrap(). They are counted by block, of which a series has one for each ``length`` rows.
    """
    keys = list(spec.keys)
    rows = Slices.of(df, spec).numbered("__tw_rn", "__tw_n")
    blocks = rows.groupBy(*keys).agg(F.max("__tw_n").alias("n")).withColumn("blocks", F.floor((F.col("n") + (length - 1)) / length))
    each = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    drawn = blocks.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))).withColumn("draw", F.explode(each))
    drawn = drawn.select(*keys, draws(F.col("split"), F.col("draw"), F.col("blocks")).alias("__tw_block"), "split")
    counted = drawn.groupBy(*keys, "__tw_block").agg(F.array(*(F.count_if(F.col("split") == s) for s in range(splits))).alias("times_drawn"))
    other = counted.withColumnsRenamed({k: f"__tw_k{i}" for i, k in enumerate(keys)} | {"__tw_block": "__tw_b"})
    same = F.floor(F.col("__tw_rn") / length) == F.col("__tw_b")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__tw_k{i}"))
    none = F.array(*[F.lit(0).cast("long")] * splits)
    return rows.join(other, same, "left").withColumn("times_drawn", F.coalesce("times_drawn", none)).select(*df.columns, "times_drawn")


def times(splits: int) -> list[Column]:
    """How often each split draws a row of block_multiplicities()."""
    return [F.get("times_drawn", F.lit(s)) for s in range(splits)]


def mean_errors(df: DataFrame, spec: SeriesSpec, length: int, splits: int = 5, quantile: float = 0.9) -> DataFrame:
    """(keys, error): the quantile over splits of the wmape of the resample's mean on the rows that it didn't draw.

    Means and errors are weighted sums over the rows as they are, in two aggregations of one column a split.
    """
    keys, y = list(spec.keys), F.col(f"`{spec.target}`")
    rows = written(block_multiplicities(df.select(*spec.columns()), spec, length, splits), "drawn")
    means = rows.groupBy(*keys).agg(F.array(*(F.sum(t * y) / F.sum(F.when(y.isNotNull(), t)) for t in times(splits))).alias("__means"))
    both = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))  # one row of means without keys
    off = [F.sum(F.when(t == 0, F.abs(y - F.get("__means", F.lit(s))))) / F.sum(F.when(t == 0, F.abs(y))) for s, t in enumerate(times(splits))]
    errors = both.groupBy(*keys).agg(F.array(*off).alias("__off"))
    known = F.array_sort(F.filter("__off", lambda v: v.isNotNull()))
    h = (F.size(known) - 1) * F.lit(float(quantile))
    low = F.get(known, F.floor(h).cast("int"))
    return errors.select(*keys, (low + (h - F.floor(h)) * (F.get(known, F.ceil(h).cast("int")) - low)).alias("error"))


def rolling_origin(df: DataFrame, spec: SeriesSpec, lags: int, horizon: int, folds: int = 3) -> DataFrame:
    """(keys, fold, part, rn, time, target): fold f is tested on the horizon that ends f horizons before the end, and trained on all before it."""
    rows = numbered(df, spec).withColumn("n", F.count(F.lit(1)).over(spec.whole()))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = F.col("n") - F.col("fold") * horizon
    part = F.when(F.col("rn") < end - horizon, "train").when(F.col("rn") < end, "test")
    return rows.where(end - horizon >= lags).withColumn("part", part).where("part IS NOT NULL").select(*spec.keys, "fold", "part", "rn", spec.time, spec.target)
