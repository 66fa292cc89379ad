"""Checks of series before training. Series that fail are returned, not raised, so the others go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import SeriesSpec
from .grid import modal_gap
from .windows import tail


def needed_rows(lags: int, intervals: bool = False, backtest: bool = False) -> int:
    return 3 * lags if backtest else 2 * lags if intervals else lags + 1


def length_check(df: DataFrame, spec: SeriesSpec, lags: int, intervals: bool = False, backtest: bool = False) -> DataFrame:
    """(keys, n, needed, ok): more than lags rows, twice as many for intervals, three times for a backtest."""
    needed = needed_rows(lags, intervals, backtest)
    out = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("needed", F.lit(needed)).withColumn("ok", F.col("n") >= F.col("needed"))


def long_enough(df: DataFrame, spec: SeriesSpec, lags: int, **kind: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of series that pass, and the check's rows of those that don't."""
    checked = length_check(df, spec, lags, **kind)
    if not spec.keys:
        return df.crossJoin(F.broadcast(checked.where("ok").select())), checked.where(~F.col("ok"))  # one row or none
    return df.join(checked.where("ok").select(*spec.keys), list(spec.keys), "left_semi"), checked.where(~F.col("ok"))


def train_before_valid(train: DataFrame, valid: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(keys, train_end, valid_start, ok)."""
    a = train.groupBy(*spec.keys).agg(F.max(spec.time).alias("train_end"))
    b = valid.groupBy(*spec.keys).agg(F.min(spec.time).alias("valid_start"))
    joined = a.join(b, list(spec.keys)) if spec.keys else a.crossJoin(F.broadcast(b))  # one row each without keys
    return joined.withColumn("ok", F.col("valid_start") > F.col("train_end"))


def pad_validation(train: DataFrame, valid: DataFrame, spec: SeriesSpec, lags: int) -> DataFrame:
    """valid, led by the last train rows of a series that has fewer than 2 * lags, if it starts a usual gap after train."""
    keys = list(spec.keys)
    size = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(spec.time).alias("__start"))
    ends = train.groupBy(*keys).agg(F.max(spec.time).alias("__end"))
    gap = modal_gap(train, spec)
    known = size.join(ends, keys).join(gap, keys) if keys else size.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(gap))  # one row each without keys
    short = known.where((F.col("__n") < 2 * lags) & (F.date_diff("__start", "__end") == F.col("gap_days"))).select(*keys, (2 * lags - F.col("__n")).alias("__need"))
    last = spec.whole().orderBy(F.col(spec.time).desc())
    ranked = tail(train, spec, 2 * lags).withColumn("__r", F.row_number().over(last))
    lead = (ranked.join(short, keys) if keys else ranked.crossJoin(F.broadcast(short))).where("__r <= __need").select(*valid.columns)
    return lead.unionByName(valid)


def ordered_distinct(df: DataFrame, spec: SeriesSpec, column: str) -> DataFrame:
    """(keys, column, first): each value once, with the time it first appears."""
    return df.groupBy(*spec.keys, column).agg(F.min(spec.time).alias("first"))
