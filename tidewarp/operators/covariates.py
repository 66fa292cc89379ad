"""Covariates of future times as they were known when a forecast was made.

A covariate has two times: the one it is about and the one it became known at; later versions replace earlier
ones. A forecast from an origin may use, for each step ahead, the last version known by the origin and none
that came later. Requests and versions are sorted together by series, time and the time of knowledge (see
slices.py), and each request takes the version carried to it: one sort, whatever the number of versions of a time.

Defined cases: a version known at the origin itself counts. Of versions of one time that became known at once
the one with the greatest values counts. A request without a version has nulls. Null times of knowledge count as
known from the start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import SeriesSpec, Step, next_time
from .slices import Slices


def running_versions(changes: DataFrame, keys: Sequence[str], known: str, values: dict[str, str]) -> DataFrame:
    """(keys, known, values): versions from changes that add up, such as new orders for a day: each the sum of all changes known by then."""
    over = Window.partitionBy(*keys).orderBy(known).rangeBetween(Window.unboundedPreceding, 0)
    sums = {name: F.sum(column).over(over) for name, column in values.items()}
    return changes.withColumns(sums).select(*keys, known, *values).distinct()


def known_ahead(origins: DataFrame, versions: DataFrame, spec: SeriesSpec, values: Sequence[str], horizon: int, origin: str = "origin", known: str = "known", freq: str | int | Step = 1) -> DataFrame:
    """(keys, origin, horizon, time, values, known) for each of the ``horizon`` steps after each row (keys, origin).

    versions has (keys, time, known, values).
    """
    keys, kind = list(spec.keys), origins.schema[origin].dataType
    asked = origins.select(*keys, origin).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    asked = asked.withColumn(spec.time, next_time(F.col(origin), F.col("horizon"), kind, Step.of(freq)))
    own = versions.select(*keys, spec.time, F.col(known).alias("__at"), F.struct(*values, F.col(known).alias("known")).alias("__v"), F.lit(False).alias("__asks"))
    both = own.unionByName(asked.withColumn("__at", F.col(origin)).withColumn("__asks", F.lit(True)), allowMissingColumns=True)
    found = Slices(both, [*keys, spec.time], ["__at", "__asks", "__v"]).carried(F.when(~F.col("__asks"), F.col("__v")))
    version = F.col("__tw_before")["v"]
    return found.where("__asks").select(*keys, origin, "horizon", spec.time, *(version[v].alias(v) for v in values), version["known"].alias("known"))
