"""Exact top-k search over binary codes by incremental multi-index hashing (operator 1).

Codes are 64 bits, cut into m segments of about log2(rows) bits, each with an index from its value to rows.
Search goes in rounds of growing radius s = 0, 1, 2, ...: a query looks up, in each segment, the values that
differ from its own in exactly s bits. After round s every row within Hamming distance m * (s + 1) - 1 has
been seen, so a query ends as soon as its k-th verified distance lies within that, and is sent no further.
A row is verified by the first segment that finds it, and kept if it is no farther than the query's k-th
distance so far, over the whole table.

A segment's index is dealt in blocks by the leading bits of the value; a block of more than ``part_rows`` rows
is dealt by row, so a value that very many rows share is no task of its own. A query goes to those blocks whose
leading bits differ from its own in at most s bits, and only its k + 1 best rows come back from each. The
directory of blocks has at most m * 2**MOST_BITS entries, whatever the input; queries are never collected.

Rows with equal codes are cut to the k + 1 smallest ids first (no more can be among the k nearest of a row),
with a limit that runs before the shuffle, so copies never meet in numbers.

Defined cases: a null vector or code has no place in the index and no neighbours; null ids are left out. An id
with several codes counts with its smallest one, as a row and as a query. Equal distances are ordered by id. A
row is not its own neighbour. Fewer than k other rows give fewer neighbours. An empty table gives an empty
result. Repeated rows are one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import cut, join_hot, table

BITS = 64
#: Bits that tell a segment's blocks apart, at most.
MOST_BITS = 10
#: Bits below those, at most: a block's table has an entry for each of their values.
LOW_BITS = 22
#: Look-ups, or rows found, that a task holds at once.
HELD = 1 << 21


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where component i is positive; components beyond ``bits`` are left out."""
    one = lambda x, i: F.when((x > 0) & (i < bits), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(vector, one), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@dataclass
class Layout:
    """How codes are cut into segments, and their values into blocks."""

    shifts: list[int]
    widths: list[int]
    highs: list[int]

    @classmethod
    def of(cls, rows: int, part_rows: int) -> Layout:
        # Segments of equal width: a short one would find a large share of the rows at once.
        m = round(BITS / min(32, max(4, math.log2(max(2, rows)))))
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        widths = [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        high = min(MOST_BITS, math.ceil(math.log2(max(1, rows / part_rows))))
        return cls(cuts[:-1], widths, [min(w, max(high, w - LOW_BITS)) for w in widths])

    def segment(self, codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(self.shifts[j])) & np.uint64((1 << self.widths[j]) - 1)).astype(np.int64)

    def block(self, codes: np.ndarray, j: int) -> np.ndarray:
        return self.segment(codes, j) >> (self.widths[j] - self.highs[j])

    def covered(self, s: int) -> int:
        """The distance within which every row has been seen after the round of radius s."""
        return BITS if s >= max(self.widths) else len(self.widths) * (s + 1) - 1


@dataclass
class Part:
    """A block, or a share of its rows."""

    j: int
    block: int
    first: int
    shares: int


class Block:
    """The rows of one part, by the low bits of their segment's value."""

    def __init__(self, layout: Layout, j: int, block: int, codes: np.ndarray, ids: np.ndarray):
        self.layout, self.j, self.block = layout, j, block
        self.low = layout.widths[j] - layout.highs[j]
        values = layout.segment(codes, j) & ((1 << self.low) - 1)
        order = np.argsort(values, kind="stable")
        self.codes, self.ids = codes[order], ids[order]
        self.starts = np.searchsorted(values[order], np.arange((1 << self.low) + 1))

    def near(self, queries: np.ndarray, bounds: np.ndarray, s: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id): of the rows that this segment is the first to find, at radius s, the k best of each query."""
        value = self.layout.segment(queries, self.j)
        apart = np.bitwise_count((value >> self.low) ^ self.block).astype(np.int64)
        found = [(np.zeros(0, np.int64),) * 3]
        for d in range(max(0, s - self.low), s + 1):
            rows = np.flatnonzero(apart == d)
            masks = np.array([sum(1 << b for b in c) for c in combinations(range(self.low), s - d)], np.int64) if len(rows) else rows
            step = max(1, HELD // max(1, len(masks)))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                probes = ((value[own] & ((1 << self.low) - 1))[:, None] ^ masks[None, :]).ravel()
                start, n = self.starts[probes], self.starts[probes + 1] - self.starts[probes]
                hit = np.flatnonzero(n)
                found += self._verified(queries, bounds, np.repeat(own, len(masks))[hit], start[hit], n[hit], s)
            found = [_best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
        return found[0]

    def _verified(self, queries: np.ndarray, bounds: np.ndarray, query: np.ndarray, start: np.ndarray, n: np.ndarray, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HELD, "right")))
            count = n[first:last]
            of = np.repeat(query[first:last], count)
            at = np.repeat(start[first:last] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            x = self.codes[at] ^ queries[of]
            far = np.bitwise_count(x).astype(np.int64)
            good = np.flatnonzero(far <= bounds[of])
            for i in range(len(self.layout.widths)):
                if i != self.j:
                    own = np.bitwise_count(self.layout.segment(x[good], i))
                    good = good[own > s if i < self.j else own >= s]
            yield of[good], far[good], self.ids[at[good]]
            first = last


def _best(query: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, far, query))
    query, far, ids = query[order], far[order], ids[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], far[kept], ids[kept]


def _postings(layout: Layout, parts: dict[tuple[int, int], Part] | None):
    """(part, code, id) a segment; without parts (part, code, id) of blocks, part telling j and block."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            code, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for j in range(len(layout.widths)):
                block = layout.block(code.view(np.uint64), j)
                if parts is None:
                    part = j << MOST_BITS + LOW_BITS | block
                else:
                    first, shares = np.zeros((2, 1 << layout.highs[j]), np.int64)
                    for (i, b), x in parts.items():
                        if i == j:
                            first[b], shares[b] = x.first, x.shares
                    mixed = ((code.view(np.uint64) ^ ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    part = first[block] + mixed % shares[block]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(code), pa.array(ids)], names=["part", "code", "id"])

    return run


def _dealt(layout: Layout, parts: dict[tuple[int, int], Part], s: int):
    """(part, code, bound): queries to all parts that radius s reaches."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            code, bound = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = [layout.block(code.view(np.uint64), j) for j in range(len(layout.widths))]
            for x in parts.values():
                near = np.flatnonzero(np.bitwise_count(own[x.j] ^ x.block) <= s)
                for share in range(x.shares if len(near) else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), x.first + share)), pa.array(code[near]), pa.array(bound[near])], names=["part", "code", "bound"])

    return run


def _search(layout: Layout, parts: dict[tuple[int, int], Part], s: int, k: int):
    """(code, distance, neighbor_id) from rows (part, asks, code, id, bound) sorted by part and asks."""
    of = {x.first + share: x for x in parts.values() for share in range(x.shares)}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in source:
            part, asks, code, ids, bound = (batch.column(i).to_numpy() for i in range(5))
            edges = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    now, held, block = part[a], [], None
                if not asks[a]:
                    held.append((code[a:b].view(np.uint64), ids[a:b]))
                    continue
                if block is None and held:
                    x = of[int(now)]
                    block = Block(layout, x.j, x.block, *(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                if block is not None:
                    query, far, found = block.near(code[a:b].view(np.uint64), bound[a:b], s, k)
                    yield pa.RecordBatch.from_arrays([pa.array(code[a:b][query]), pa.array(far, pa.int32()), pa.array(found, pa.int64())], names=["code", "distance", "neighbor_id"])

    return run


def _one_code(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code"))
    return rows.where("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"))


def nearest(index: DataFrame, asked: DataFrame, k: int, part_rows: int) -> DataFrame:
    """(code, distance, neighbor_id, radius, covered): the k nearest rows (code, id) of each asked code, and where its search ended."""
    rows = index.count()
    layout = Layout.of(rows, part_rows)
    counts = index.select("code", "id").mapInArrow(_postings(layout, None), "part long, code long, id long").groupBy("part").count().collect()
    parts: dict[tuple[int, int], Part] = {}
    first = 0
    for part, count in sorted(counts):
        j, block = part >> MOST_BITS + LOW_BITS, part & ((1 << MOST_BITS + LOW_BITS) - 1)
        parts[j, block] = Part(j, block, first, math.ceil(count / part_rows))
        first += parts[j, block].shares
    postings = cut(index.select("code", "id").mapInArrow(_postings(layout, parts), "part long, code long, id long"), "codes-postings")
    postings = postings.select("part", F.lit(0).alias("asks"), "code", "id", F.lit(0).cast("long").alias("bound"))
    need = min(k, rows)
    best = Window.partitionBy("code").orderBy("distance", "neighbor_id")
    left = asked.select("code").distinct().withColumn("bound", F.lit(BITS).cast("long"))
    schema = "code long, distance int, neighbor_id long"
    held = done = asked.sparkSession.createDataFrame([], schema)
    done = done.withColumns({"radius": F.lit(0), "covered": F.lit(0)})
    for s in range(max(layout.widths) + 1):
        queries = left.select("code", "bound").mapInArrow(_dealt(layout, parts, s), "part long, code long, bound long")
        dealt = postings.unionByName(queries.select("part", F.lit(1).alias("asks"), "code", F.lit(0).cast("long").alias("id"), "bound"))
        fresh = dealt.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(_search(layout, parts, s, k), schema)
        held = cut(held.unionByName(fresh).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "codes-nearest")
        reach = held.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        full = F.col("n") >= need
        state = left.select("code").join(reach, "code", "left").withColumn("ended", F.coalesce(full & (F.col("far") <= layout.covered(s)), F.lit(False)))
        state = cut(state.withColumn("bound", F.when(full, F.col("far")).otherwise(F.lit(BITS)).cast("long")), "codes-state")
        ended = held.join(state.where("ended").select("code"), "code", "left_semi")
        done = done.unionByName(ended.withColumns({"radius": F.lit(s), "covered": F.lit(layout.covered(s))}))
        left = state.where("NOT ended").select("code", "bound")
        if left.isEmpty():
            break
        held = held.join(left.select("code"), "code", "left_semi")
    return done


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, part_rows: int = 1 << 16) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) for queries (id, code) against codes (id, code)."""
    ship(codes)
    same = Window.partitionBy("code").orderBy("id")
    index = cut(_one_code(codes).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"), "codes-index")
    asked = cut(_one_code(queries), "codes-asked")
    found = nearest(index, asked, k + 1, part_rows)
    lists = found.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("found"))
    lists = lists.join(asked.groupBy("code").agg(F.count(F.lit(1)).alias("ids")), "code")
    mine = join_hot(asked, lists, "code", "ids", asked.count(), "id")
    mine = mine.select("id", F.slice(F.filter("found", lambda x: x["neighbor_id"] != F.col("id")), 1, k).alias("found"))
    out = mine.select(F.col("id").alias("query_id"), F.posexplode("found").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def op1_topk_codes(spark, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.where(F.col("id") % 20 == 0), k=10)


OP1_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), u AS (
  SELECT vec_id, array_to_string(list_transform(bits, lambda b: CASE WHEN b THEN '1' ELSE '0' END), '')::BIT AS code FROM c
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id, bit_count(xor(q.code, d.code))::INT AS distance
  FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p
)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
