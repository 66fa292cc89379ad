"""Generated series: (i, y) tables from seeded expressions, a partition for each million rows; and waves, noise and walks at the rows of given series.

The latter are functions of a row's position and a seed alone, so a row gets the same value in any layout and
after any lost task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.slices import Slices
from ..series import SeriesSpec


BLOCK = 1_000_000


def _range(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(0, size, numPartitions=max(1, math.ceil(size / BLOCK)))


def trigonometry(spark: SparkSession, size: float = 100, factors: tuple[float, float, float] = (0.4, 0.4, 0.2), seed: int = 0) -> DataFrame:
    """a sin(i) + b cos(i) + c noise, i = 0 ... ceil(size) - 1."""
    a, b, c = factors
    i = F.col("id").cast("double")
    y = F.lit(a) * F.sin(i) + F.lit(b) * F.cos(i)
    if c:
        y = y + F.lit(c) * F.randn(seed)
    return _range(spark, math.ceil(size)).select(F.col("id").alias("i"), y.alias("y"))


def white_noise(spark: SparkSession, size: int = 100, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> DataFrame:
    return _range(spark, size).select(F.col("id").alias("i"), (F.randn(seed) * std + mean).alias("y"))


def random_walk(spark: SparkSession, size: int = 100, started_zero: bool = True, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Running sum of N(0, 1); the first value is 0 or a draw. Blocks are summed on their own, then the blocks' sums."""
    step = F.when((F.col("i") == 0) & F.lit(started_zero), 0.0).otherwise(F.col("y"))
    steps = white_noise(spark, size, seed=seed).select("i", step.alias("step"), F.floor(F.col("i") / block).alias("b"))
    sums = steps.groupBy("b").agg(F.sum("step").alias("s"))
    # One row for each block of a million.
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))
    inside = steps.withColumn("y", F.sum("step").over(Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(before, "b").select("i", (F.col("y") + F.col("before")).alias("y"))


def random_events(spark: SparkSession, size: int = 1000, seasons: int | None = None, factors: tuple[float, ...] = (0.5, 0.3, 0.2), levels: int = 6, seed: int = 0) -> DataFrame:
    """10 * seasonal level + 8 * each of ``levels`` trends + noise; a level holds for size // seasons steps."""
    import random

    draw = random.Random(seed)
    base = _range(spark, size).select(F.col("id").alias("i"), F.randn(seed).alias("noise"))
    y = F.col("noise")
    for k in range(levels):
        a, b, c = (draw.choice(factors) for _ in range(3))
        i = F.col("i").cast("double")
        y = y + 8 * (a * F.sin(i) + b * F.cos(i) + c * F.randn(seed + k + 1))
    if seasons:
        heights = [draw.gauss(0, 1) for _ in range(seasons)]
        block = max(1, size // seasons)
        at = F.when(F.col("i") < block * seasons, F.floor(F.col("i") / block)).otherwise(F.col("i") - block * seasons).cast("int")
        y = y + 10 * F.get(F.array(*map(F.lit, heights)), at)
    return base.select("i", y.alias("y"))


def wave(i: Column, a: float = 0.4, b: float = 0.4) -> Column:
    """a sin(i) + b cos(i)."""
    i = i.cast("double")
    return F.lit(a) * F.sin(i) + F.lit(b) * F.cos(i)


def _uniform(what: str, seed: int, *of: Column) -> Column:
    """Above 0 and below 1, by 48 bits of md5 of the seed and the given columns as text."""
    text = F.concat_ws(":", F.lit(f"{what}:{seed}"), *(c.cast("string") for c in of))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(seed: int, *of: Column) -> Column:
    """A draw of N(0, 1) that depends on the seed and the given columns alone (two uniform ones, by polar coordinates)."""
    return F.sqrt(-2 * F.log(_uniform("radius", seed, *of))) * F.cos(2 * math.pi * _uniform("angle", seed, *of))


def with_noise(df: DataFrame, spec: SeriesSpec, mean: float = 0.0, std: float = 1.0, seed: int = 0, name: str = "noise") -> DataFrame:
    """df with a draw of N(mean, std) for each row of each series."""
    rows = Slices.of(df, spec).numbered("__tw_rn")
    return rows.withColumn(name, normal(seed, *map(F.col, spec.keys), F.col("__tw_rn")) * std + mean).drop("__tw_rn")


def with_walk(df: DataFrame, spec: SeriesSpec, started_zero: bool = True, seed: int = 0, name: str = "walk") -> DataFrame:
    """df with a random walk along each series: the running sum of N(0, 1), from 0 or from a draw."""
    step = F.when((F.col("__tw_rn") == 0) & F.lit(started_zero), 0.0).otherwise(normal(seed, *map(F.col, spec.keys), F.col("__tw_rn")))
    rows = Slices.of(df, spec).numbered("__tw_rn").withColumn("__tw_step", step)
    return Slices.of(rows, spec).running_sum(F.col("__tw_step"), name).drop("__tw_rn", "__tw_step")


def with_seasons(df: DataFrame, spec: SeriesSpec, seasons: int, seed: int = 0, name: str = "level") -> DataFrame:
    """df with seasonal levels: each series in ``seasons`` stretches of equal length, each at 10 times a draw; rows that are left over start again."""
    rows = Slices.of(df, spec).numbered("__tw_rn", "__tw_n")
    length = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__tw_n") / seasons))
    season = F.when(F.col("__tw_rn") < length * seasons, F.floor(F.col("__tw_rn") / length)).otherwise(F.col("__tw_rn") - length * seasons)
    return rows.withColumn(name, 10 * normal(seed, *map(F.col, spec.keys), season)).drop("__tw_rn", "__tw_n")
