"""Ranking of scored models, per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, keys: list[str], metric: str, less_is_better: bool = True, name: str = "model") -> DataFrame:
    """scores with rank, 1 for the best of a series; equal scores by name, missing ones last."""
    by = F.col(metric).asc_nulls_last() if less_is_better else F.col(metric).desc_nulls_last()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by, name)))


def best(scores: DataFrame, keys: list[str], metric: str, less_is_better: bool = True, name: str = "model") -> DataFrame:
    """The best row of each series."""
    return ranked(scores, keys, metric, less_is_better, name).where("rank = 1").drop("rank")
