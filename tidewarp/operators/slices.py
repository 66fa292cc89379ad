"""Series cut in time slices, so that one long series is worked on by many tasks.

A window partitioned by a series' keys puts the whole series in one task; without keys, the whole table. Here
the rows are sorted by keys and time in ranges of about equal numbers of rows (Spark samples the bounds), and
written once. A range of one series is a slice. What a slice has to know of the others is one row a slice:

* positions: how many rows of the series come before it (numbered());
* neighbours: rows go to the blocks of BLOCK positions whose windows reach them, so a block has its own rows
  and a halo of those just before and after (blocks()). No other row is copied;
* carries: the last known value before the slice and the first one after it, by a scan over the slices' ends (carried()).

All exchanges are by range, by slice or by block, so no task receives more than one of these. Making Slices
runs the jobs that sort and count; what the methods return is lazy and reads the written tables.

Defined cases: rows of equal keys and time keep an order, but any. Null times come first, null keys are a
series. An empty table gives empty results. Columns of the table may have any names but those starting with __tw_.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.tables import written
from ..series import SeriesSpec

#: Positions of a block; more where halos would be more than a quarter of it.
BLOCK = 1 << 16

#: monotonically_increasing_id() has the partition above these bits and the place in it below.
_PLACE = 33


class Slices:
    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None):
        """df sorted by keys and order; ``parts`` is the number of ranges (by default as many as shuffle partitions, fewer for little data)."""
        self.columns, self.keys = df.columns, list(keys)
        by = [*self.keys, *order]
        dealt = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
        placed = dealt.sortWithinPartitions(*by).withColumn("__tw_id", F.monotonically_increasing_id())
        slice_, at = F.shiftright("__tw_id", _PLACE).cast("int"), F.col("__tw_id").bitwiseAND(F.lit((1 << _PLACE) - 1))
        self.sorted = written(placed.select(*self.columns, slice_.alias("__tw_slice"), at.alias("__tw_at")), "slices")

    @classmethod
    def of(cls, df: DataFrame, spec: SeriesSpec, parts: int | None = None) -> Slices:
        """A table of series in order of time."""
        return cls(df, spec.keys, [spec.time], parts)

    def _summary(self, *more: Column) -> DataFrame:
        """(keys, __tw_slice, __tw_base, __tw_total, more): a row a slice. A row's position is its place plus the base."""
        ends = self.sorted.groupBy(*self.keys, "__tw_slice").agg(F.min("__tw_at").alias("__tw_first"), F.count(F.lit(1)).alias("__tw_rows"), *more)
        before = Window.partitionBy(*self.keys).orderBy("__tw_slice").rowsBetween(Window.unboundedPreceding, -1)
        base = F.coalesce(F.sum("__tw_rows").over(before), F.lit(0)) - F.col("__tw_first")
        return ends.withColumns({"__tw_base": base, "__tw_total": F.sum("__tw_rows").over(Window.partitionBy(*self.keys))}).drop("__tw_first", "__tw_rows")

    @cached_property
    def ends(self) -> DataFrame:
        return written(self._summary(), "slice-ends")

    def _joined(self, ends: DataFrame) -> DataFrame:
        """Rows with what their slice has; the exchange, if there is one, is by slice and keys."""
        other = ends.withColumnsRenamed({c: f"__tw_k{i}" for i, c in enumerate([*self.keys, "__tw_slice"])})
        same = reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"__tw_k{i}")) for i, c in enumerate([*self.keys, "__tw_slice"])))
        return self.sorted.join(other, same).drop(*(f"__tw_k{i}" for i in range(len(self.keys) + 1)))

    def numbered(self, position: str = "rn", total: str | None = None) -> DataFrame:
        """All rows with their position in their series, from 0, and with ``total`` the number of its rows; both long."""
        rows = self._joined(self.ends)
        names = {position: F.col("__tw_at") + F.col("__tw_base")} | ({total: F.col("__tw_total")} if total else {})
        return rows.withColumns(names).select(*(c for c in self.columns if c not in names), *names)

    def blocks(self, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec]:
        """Rows with __tw_rn (position), __tw_total, __tw_block and __tw_own, and the window over a block in order.

        A block has its own rows, the ``before`` ones before them and the ``after`` ones after; filter by __tw_own when done.
        """
        size = max(BLOCK, 4 * (before + after))
        rows = self.numbered("__tw_rn", "__tw_total")
        at = lambda p: F.floor(p / F.lit(size)).cast("long")
        first = at(F.greatest(F.col("__tw_rn") - after, F.lit(0).cast("long")))
        last = at(F.least(F.col("__tw_rn") + before, F.col("__tw_total") - 1))
        dealt = rows.withColumn("__tw_block", F.explode(F.sequence(first, last)))
        dealt = dealt.withColumn("__tw_own", F.col("__tw_block") == at(F.col("__tw_rn")))
        return dealt, Window.partitionBy(*self.keys, "__tw_block").orderBy("__tw_rn")

    def carried(self, value: Column) -> DataFrame:
        """Rows with __tw_rn, and __tw_before and __tw_after: struct (rn, v) of the nearest known value at or before, and at or after, the row."""
        known = F.when(value.isNotNull(), F.struct(F.col("__tw_at").alias("rn"), value.alias("v")))
        ends = self._summary(F.max_by(known, F.when(known.isNotNull(), F.col("__tw_at"))).alias("__tw_last"), F.min_by(known, F.when(known.isNotNull(), F.col("__tw_at"))).alias("__tw_head"))
        placed = {c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["rn"] + F.col("__tw_base")).alias("rn"), F.col(c)["v"].alias("v"))) for c in ("__tw_last", "__tw_head")}
        scan = Window.partitionBy(*self.keys)
        # Backwards by a descending order: a frame that ends at the last row is worked out anew for each row.
        past = F.last("__tw_last", True).over(scan.orderBy("__tw_slice").rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.last("__tw_head", True).over(scan.orderBy(F.desc("__tw_slice")).rowsBetween(Window.unboundedPreceding, -1))
        ends = written(ends.withColumns(placed).withColumns({"__tw_past": past, "__tw_ahead": ahead}).drop("__tw_last", "__tw_head"), "slice-carries")
        rows = self._joined(ends).withColumn("__tw_rn", F.col("__tw_at") + F.col("__tw_base"))
        own = F.when(value.isNotNull(), F.struct(F.col("__tw_rn").alias("rn"), value.alias("v")))
        inside = Window.partitionBy(*self.keys, "__tw_slice")
        upto = Window.unboundedPreceding, Window.currentRow
        rows = rows.withColumn("__tw_known", own).withColumns({
            "__tw_before": F.coalesce(F.last("__tw_known", True).over(inside.orderBy("__tw_at").rowsBetween(*upto)), F.col("__tw_past")),
            "__tw_after": F.coalesce(F.last("__tw_known", True).over(inside.orderBy(F.desc("__tw_at")).rowsBetween(*upto)), F.col("__tw_ahead")),
        })
        return rows.select(*self.columns, "__tw_rn", "__tw_before", "__tw_after")

    def running_sum(self, value: Column, name: str) -> DataFrame:
        """All rows with the sum of value over them and the rows of their series before them; nulls add nothing."""
        ends = self._summary(F.sum(value).alias("__tw_sum"))
        before = F.sum("__tw_sum").over(Window.partitionBy(*self.keys).orderBy("__tw_slice").rowsBetween(Window.unboundedPreceding, -1))
        rows = self._joined(written(ends.withColumn("__tw_past", before).drop("__tw_sum"), "slice-sums"))
        inside = Window.partitionBy(*self.keys, "__tw_slice").orderBy("__tw_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.sum(value).over(inside)
        total = F.coalesce(own + F.col("__tw_past"), own, F.col("__tw_past"))
        return rows.withColumn(name, total).select(*(c for c in self.columns if c != name), name)


def own_rows(rows: DataFrame) -> DataFrame:
    """The rows of blocks() without halos and without what blocks() added."""
    return rows.where("__tw_own").drop("__tw_rn", "__tw_total", "__tw_block", "__tw_own")
