"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import cut, join_hot

#: Edges that a task contracts at once.
HELD = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Few files for few rows: about a million edges a file."""
    return df.coalesce(max(4, math.ceil(rows / 1_000_000)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of every node that isn't its own least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    below = np.flatnonzero(root < np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars around least nodes."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, n = [], 0
    for batch in source:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n > HELD:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(node, component) from edges (a, b): component is the least node reachable. Nodes without edges are left out.

    Tasks first contract their own edges to stars. Then two contractions alternate until nothing changes, each
    a grouped minimum and a join: neighbours above a node go to the node's least neighbour, then a node's lower
    neighbours do. The number of rounds grows as the logarithm of the longest chain. Nodes with very many
    neighbours are broadcast (see join_hot). If the contracted edges are ``held`` or fewer, which one task contracts
    at once, there are no rounds.
    """
    now = ship(edges).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_contract, "u long, v long")
    now = cut(now.distinct(), "edges")
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if last == tuple(state) or not state[0]:
            break
        if state[0] <= held:
            now = cut(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")
            break
        last = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        up = join_hot(both, least, "u", "n", 2 * state[0], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = cut(_small(up, state[0]), "edges")
        lowest = up.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        down = join_hot(up, lowest, "u", "n", state[0], "v")
        down = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = cut(_small(down.distinct(), state[0]), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
