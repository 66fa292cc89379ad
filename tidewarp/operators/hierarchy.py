"""Forecasts of parts and totals that agree.

A hierarchy is a table of edges (node, parent), a forest of any depth; its leaves may lie at any level. Forecasts
are rows (keys, time, target), with one key that names the node; other keys and the time make a cell, and
cells are reconciled each on their own.

* bottom_up(): leaves stay; every other node is the sum of its leaves, by the sparse summing matrix (node, leaf).
* top_down(): roots stay; leaves get their root's value by their share of past sums.
* least_squares(): the sums that agree and are nearest to all forecasts, by weighted least squares. On a forest that
  takes two passes over the levels instead of a matrix: upwards each node learns how steeply its cost rises
  with its total (weight) and where it is least (best), from its children's; downwards each total is dealt to the
  children by the inverse of their weights.

All three end in bottom_up(), so totals are the sums of what is returned for their leaves. Work is by joins on
(node, cell); the driver only loops over levels. Levels are written tables, so plans don't grow with depth.

Defined cases: edges may repeat; a node with two parents or in a cycle is an error. A leaf without a forecast (or
with null) takes no part in its cell; a total then covers the others. Other nodes without a forecast just
have no say. Nodes that no edge names are roots without parts and stay as they are. Shares of a root whose past
sums are 0 are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..series import SeriesSpec


class Hierarchy:
    def __init__(self, edges: DataFrame, node: str = "node", parent: str = "parent"):
        """The levels of a forest from its edges; runs a few jobs a level."""
        edges = written(edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
        if not edges.groupBy("node").count().where("count > 1").isEmpty():
            raise ValueError("a node has two parents")
        roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
        #: One table a level: (node, parent, root), roots first.
        self.levels = [written(roots.select("node", F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), F.col("node").alias("root")), "level")]
        total, seen = edges.count(), 0
        while True:
            above = self.levels[-1].select(F.col("node").alias("parent"), "root")
            found = written(edges.join(above, "parent").select("node", "parent", "root"), "level")
            n = found.count()
            if not n:
                break
            seen += n
            self.levels.append(found)
        if seen < total:
            raise ValueError("the hierarchy has a cycle")
        inner = edges.select(F.col("parent").alias("node")).distinct()
        nodes = self.levels[0]
        for level in self.levels[1:]:
            nodes = nodes.unionByName(level)
        self.leaves = written(nodes.join(inner, "node", "left_anti").select("node", "root"), "leaves")

    def summing(self) -> DataFrame:
        """(node, leaf): the ones of the summing matrix; a leaf is its own."""
        up = [self.leaves.select("node", F.col("node").alias("leaf"))]
        parents = self.levels[0].select("node", "parent")
        for level in self.levels[1:]:
            parents = parents.unionByName(level.select("node", "parent"))
        for _ in self.levels[1:]:
            up.append(written(up[-1].join(parents, "node").where("parent IS NOT NULL").select(F.col("parent").alias("node"), "leaf"), "summing"))
        out = up[0]
        for level in up[1:]:
            out = out.unionByName(level)
        return out

    # --- reconciling

    def _alone(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of nodes that the hierarchy doesn't name."""
        nodes = self.levels[0].select("node")
        for level in self.levels[1:]:
            nodes = nodes.unionByName(level.select("node"))
        return rows.join(nodes.withColumnRenamed("node", key), key, "left_anti")

    def bottom_up(self, forecasts: DataFrame, spec: SeriesSpec) -> DataFrame:
        """(keys, time, target) of all nodes, from the leaves' forecasts."""
        key, cell, y = spec.keys[0], [*spec.keys[1:], spec.time], spec.target
        rows = forecasts.select(key, *cell, y).where(F.col(y).isNotNull())
        leaf = rows.join(self.leaves.select(F.col("node").alias(key)), key, "left_semi").withColumnRenamed(key, "leaf")
        sums = leaf.join(self.summing(), "leaf").groupBy("node", *cell).agg(F.sum(y).alias(y))
        return sums.select(F.col("node").alias(key), *cell, y).unionByName(self._alone(rows, key))

    def top_down(self, forecasts: DataFrame, past: DataFrame, spec: SeriesSpec) -> DataFrame:
        """(keys, time, target) of all nodes: the roots' forecasts, dealt to the leaves by the sums of past (keys, time, target)."""
        key, cell, y = spec.keys[0], [*spec.keys[1:], spec.time], spec.target
        others = list(spec.keys[1:])
        rows = forecasts.select(key, *cell, y).where(F.col(y).isNotNull())
        history = past.groupBy(key, *others).agg(F.sum(y).alias("__past"))
        leaves = self.leaves.withColumnRenamed("node", key)
        cells = rows.withColumnRenamed(key, "root").join(leaves, "root")
        known = cells.join(history, [key, *others], "left").withColumn("__past", F.coalesce("__past", F.lit(0.0)))
        whole = known.groupBy("root", *cell).agg(F.sum("__past").alias("__whole"), F.count(F.lit(1)).alias("__n"))
        share = F.when(F.col("__whole") == 0, 1 / F.col("__n")).otherwise(F.col("__past") / F.col("__whole"))
        dealt = known.join(whole, ["root", *cell]).select(key, *cell, (F.col(y) * share).alias(y))
        return self.bottom_up(dealt, spec).unionByName(self._alone(rows, key))

    def least_squares(self, forecasts: DataFrame, spec: SeriesSpec, weight: str | None = None) -> DataFrame:
        """(keys, time, target) of all nodes; ``weight`` is a column of positive weights (by default all count the same)."""
        key, cell, y = spec.keys[0], [*spec.keys[1:], spec.time], spec.target
        rows = forecasts.select(F.col(key).alias("node"), *cell, F.col(y).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).where("__y IS NOT NULL")
        rows, states, below = written(rows, "forecasts"), [], None
        for level in reversed(self.levels):
            leaf = level.join(self.leaves.select("node"), "node", "left_semi").join(rows, "node")
            leaf = leaf.select("node", "parent", *cell, F.col("__w").alias("weight"), F.col("__y").alias("best"), F.lit(None).cast("double").alias("easy"), F.lit(None).cast("double").alias("sum"))
            state = leaf
            if below is not None:
                parts = below.groupBy("parent", *cell).agg(F.sum(1 / F.col("weight")).alias("easy"), F.sum("best").alias("sum")).withColumnRenamed("parent", "node")
                inner = level.select("node", "parent").join(parts, "node").join(rows, ["node", *cell], "left")
                own, pull = F.coalesce("__w", F.lit(0.0)), 1 / F.col("easy")
                best = (pull * F.col("sum") + own * F.coalesce("__y", F.lit(0.0))) / (pull + own)
                state = leaf.unionByName(inner.select("node", "parent", *cell, (pull + own).alias("weight"), best.alias("best"), "easy", "sum"))
            below = written(state, "upward")
            states.append(below)
        above = states[-1].withColumn("total", F.col("best"))
        leaves = [above.where("easy IS NULL")]
        for state in reversed(states[:-1]):
            told = above.where("easy IS NOT NULL").select(F.col("node").alias("parent"), *cell, F.col("easy").alias("__easy"), F.col("sum").alias("__sum"), F.col("total").alias("__total"))
            total = F.col("best") + (F.col("__total") - F.col("__sum")) / F.col("weight") / F.col("__easy")
            above = written(state.join(told, ["parent", *cell]).withColumn("total", total).select(*state.columns, "total"), "downward")
            leaves.append(above.where("easy IS NULL"))
        found = leaves[0]
        for x in leaves[1:]:
            found = found.unionByName(x)
        agreed = self.bottom_up(found.select(F.col("node").alias(key), *cell, F.col("total").alias(y)), spec)
        return agreed.unionByName(self._alone(forecasts.select(key, *cell, F.col(y).cast("double").alias(y)).where(F.col(y).isNotNull()), key))
