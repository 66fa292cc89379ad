"""Regular grids: gaps, filling, interpolation, outlier repair, future times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import SeriesSpec, Step, next_time, wall_seconds
from .slices import Slices, own_rows


def _gaps(df: DataFrame, spec: SeriesSpec, unit: str) -> DataFrame:
    """(keys, time, after, gap_days or gap_seconds): each row but a series' first, with the time before it and how long ago that was on the series' own clock."""
    if unit not in ("days", "seconds"):
        raise ValueError("gaps are in days or seconds")
    rows, over = Slices.of(df.select(*spec.keys, spec.time), spec).blocks(before=1)
    rows = own_rows(rows.withColumn("after", F.lag(spec.time).over(over)))
    if unit == "days":
        gap = F.date_diff(spec.time, "after")
    else:
        gap = wall_seconds(F.col(spec.time), df.schema[spec.time].dataType) - wall_seconds(F.col("after"), df.schema[spec.time].dataType)
    return rows.withColumn(f"gap_{unit}", gap).where(F.col(f"gap_{unit}").isNotNull())


def sampling_gaps(df: DataFrame, spec: SeriesSpec, unit: str = "days") -> DataFrame:
    """(keys, gap_days or gap_seconds, n): how often neighbours are so far apart."""
    name = f"gap_{unit}"
    return _gaps(df, spec, unit).groupBy(*spec.keys, name).agg(F.count(F.lit(1)).alias("n"))


def modal_gap(df: DataFrame, spec: SeriesSpec, unit: str = "days") -> DataFrame:
    """(keys, gap_days or gap_seconds): the commonest gap, the smallest of several."""
    name = f"gap_{unit}"
    best = F.max_by(name, F.struct(F.col("n"), -F.col(name)))
    return sampling_gaps(df, spec, unit).groupBy(*spec.keys).agg(best.alias(name))


def gap_report(df: DataFrame, spec: SeriesSpec, usual: int = 1) -> DataFrame:
    """(keys, after, gap_days): where more than the usual number of days pass."""
    return _gaps(df, spec, "days").where(F.col("gap_days") > usual).select(*spec.keys, "after", "gap_days")


def regularise(df: DataFrame, spec: SeriesSpec, fill: float | None = None, step_days: int = 1, freq: str | int | Step | None = None, static: DataFrame | None = None, hierarchy: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each step from a series' first to its last time; missing targets are null or ``fill``.

    ``freq`` is a frequency such as h, D, MS in place of days. ``static`` has a row for each series, whose columns
    are added to all of its rows. ``hierarchy`` names, for a key's value, the values that it is the total of;
    the totals' series are added, with a null target where any part has none.
    """
    kind, step = df.schema[spec.time].dataType, Step.of(step_days if freq is None else freq)
    ends = df.groupBy(*spec.keys).agg(F.min(spec.time).alias("__a"), F.max(spec.time).alias("__b"))
    if step.months:
        count = F.floor(F.months_between(F.trunc("__b", "month"), F.trunc("__a", "month")) / step.months).cast("int")
    else:
        count = F.floor((wall_seconds(F.col("__b"), kind) - wall_seconds(F.col("__a"), kind)) / step.seconds).cast("int")
    grid = ends.withColumn("__i", F.explode(F.sequence(F.lit(0), count)))
    grid = grid.withColumn(spec.time, next_time(F.col("__a"), F.col("__i"), kind, step)).where(F.col(spec.time) <= F.col("__b")).select(*spec.keys, spec.time)
    out = grid.join(df, [*spec.keys, spec.time], "left")
    if fill is not None:
        out = out.withColumn(spec.target, F.coalesce(spec.target, F.lit(fill)))
    if hierarchy:
        out = with_totals(out, spec, hierarchy)
    return out if static is None else out.join(static, list(spec.keys), "left")


def with_totals(df: DataFrame, spec: SeriesSpec, hierarchy: dict[str, list[str]]) -> DataFrame:
    """df and a series for each total: the first key names it, other keys and times are those of its parts, other columns are null."""
    key = spec.keys[0]
    pairs = [(total, part) for total, parts in hierarchy.items() for part in parts]
    named = df.sparkSession.createDataFrame(pairs, f"__total string, {key} string")
    n = F.create_map(*[x for total, parts in hierarchy.items() for x in (F.lit(total), F.lit(len(parts)))])
    whole = (F.count(spec.target) == F.element_at(n, F.col("__total"))).alias("__whole")
    sums = df.join(F.broadcast(named), key).groupBy("__total", *spec.keys[1:], spec.time).agg(F.sum(spec.target).alias("__sum"), whole)
    sums = sums.select(F.col("__total").alias(key), *spec.keys[1:], spec.time, F.when(F.col("__whole"), F.col("__sum")).alias(spec.target))
    return df.unionByName(sums, allowMissingColumns=True)


def forward_fill(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Unknown values become the last known one; slices carry theirs on."""
    rows = Slices.of(df, spec).carried(F.col(f"`{spec.target}`"))
    return rows.withColumn(spec.target, F.col("__tw_before")["v"]).select(*df.columns)


def interpolate(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Linear by position between known values; after the last one it stays, before the first it is null."""
    rows = Slices.of(df, spec).carried(F.col(f"`{spec.target}`"))
    a, b = F.col("__tw_before"), F.col("__tw_after")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("__tw_rn") - a["rn"]) / (b["rn"] - a["rn"])
    value = F.when(b["rn"].isNull() | (b["rn"] == a["rn"]), a["v"]).otherwise(line)
    return rows.withColumn(spec.target, F.coalesce(F.col(f"`{spec.target}`"), value)).select(*df.columns)


def repair_outliers(df: DataFrame, spec: SeriesSpec, window: int = 7, limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` deviations from the mean of the rows around become that mean; outlier tells which."""
    rows, over = Slices.of(df, spec).blocks(before=window, after=window)
    around = over.rowsBetween(-window, window)
    rows = rows.withColumns({"__tw_m": F.avg(spec.target).over(around), "__tw_s": F.stddev_pop(spec.target).over(around)})
    odd = F.coalesce(F.abs(F.col(spec.target) - F.col("__tw_m")) > limit * F.col("__tw_s"), F.lit(False))
    rows = own_rows(rows.withColumn("outlier", odd).withColumn(spec.target, F.when(F.col("outlier"), F.col("__tw_m")).otherwise(F.col(spec.target))))
    return rows.drop("__tw_m", "__tw_s")


def future_index(df: DataFrame, spec: SeriesSpec, n: int, step_days: int = 1, freq: str | int | Step | None = None) -> DataFrame:
    """(keys, horizon, time): the n steps after each series' last time."""
    kind, step = df.schema[spec.time].dataType, Step.of(step_days if freq is None else freq)
    last = df.groupBy(*spec.keys).agg(F.max(spec.time).alias("__b"))
    ahead = last.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return ahead.withColumn(spec.time, next_time(F.col("__b"), F.col("horizon"), kind, step)).select(*spec.keys, "horizon", spec.time)
