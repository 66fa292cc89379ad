"""Filter interaction audit by an incidence matrix product (operator 13).

What an order of filters keeps and removes depends on one thing only: which filters each document fails. So

1. one pass over the texts gives each document a mask of the filters it fails (a bit a filter) and a digest;
2. documents are counted by part and mask, all of them, those labelled good and those labelled toxic. A part
   is then three rows of 2^filters counts, whatever the number of its documents;
3. these rows, stacked, are multiplied by integer matrices with a row for each mask and a column for each step
   of each order: a 1 where a document with that mask is kept, removed, found redundant, or fails nothing else.

Filters are named expressions over the text. The last one is about the whole table: a text that a smaller id
has too. Its digests meet in a map-side combined minimum, and documents find that minimum with digests that
very many rows share broadcast (see common.join_hot), so copies never meet in one task. Texts are not shuffled.

Defined cases: null text equals '', null part is '' (and counted with it). A null id has no label, is no
copy, and makes no other row one. Repeated rows count each; rows of one id are no copies of each other. Of
several labels of an id the largest counts, a null label counts as none. Texts of any length are read whole.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import cut, join_hot, table, text_or_empty

#: Counts of a part: all documents, those of good quality, toxic ones.
KINDS = ("every", "good", "toxic")


def words(text: Column) -> Column:
    """The maximal runs of anything but \\x20 and \\x09 to \\x0D."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions over a text alone, by letter."""
    found = words(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(found) < 100,
        "B": F.lit(100) * F.size(F.array_distinct(found)) < F.lit(80) * F.size(found),
        "C": F.lit(100) * capitals > F.lit(10) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def incidence(letters: str) -> dict[str, np.ndarray]:
    """The matrices: a row for each mask (bit i is letter i), a column for each step of each order.

    kept: fails none of the filters so far. removed: fails this one and none before. redundant: fails this one
    and one before. unique: fails this one alone. Column s of order o is at len(letters) * o + s.
    """
    masks = np.arange(1 << len(letters))[:, None]
    steps = [(sum(1 << letters.index(x) for x in order[:s]), 1 << letters.index(order[s])) for order in orders(letters) for s in range(len(letters))]
    before, own = (np.array(x)[None, :] for x in zip(*steps, strict=True))
    earlier, fails = masks & before != 0, masks & own != 0
    out = {"kept": ~earlier & ~fails, "removed": ~earlier & fails, "redundant": earlier & fails, "unique": masks == own}
    return {k: v.astype(np.int64) for k, v in out.items()}


def document_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): documents and the filters of text_filters() and, as the last bit, of copies that they fail.

    Rows that agree in everything are one row with their number n.
    """
    text = text_or_empty(text_col)
    bits = [cond.cast("int") * F.lit(1 << i) for i, cond in enumerate(text_filters(F.col("text")).values())]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(part_col).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    rows = cut(rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = cut(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "audit-copies")
    total = first.agg(F.sum("rows")).first()[0] or 0
    copies = join_hot(rows, first, "digest", "rows", total, "id", "left")
    copy = F.coalesce(F.col("first") < F.col("id"), F.lit(False)).cast("int")
    return copies.select("id", "part", (F.col("mask") + copy * F.lit(1 << len(bits))).alias("mask"), "n")


def histograms(masks: DataFrame, labels: DataFrame, width: int, id_col: str = "doc_id") -> DataFrame:
    """(part, every, good, toxic): a part's documents by mask, each an array of ``width`` counts."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), *(F.col(c).cast("int") for c in ("quality", "toxic"))).where("id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = masks.join(known, "id", "left")
    sums = [F.sum(F.when(cond, F.col("n")).otherwise(0)) for cond in (F.lit(True), F.col("quality") == 1, F.col("toxic") == 1)]
    cells = rows.groupBy("part", "mask").agg(*(s.alias(k) for s, k in zip(sums, KINDS, strict=True)))
    found = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS)))).alias("cells"))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    each = lambda kind: F.transform(places, lambda i: F.coalesce(F.col("cells")[i][kind], F.lit(0).cast("long")))
    return found.select("part", *(each(k).alias(k) for k in KINDS))


def _product(letters: str):
    """The rows of a batch of parts, by one product for each matrix."""
    m, width = incidence(letters), 1 << len(letters)
    names = orders(letters)
    own = np.array([letters.index(x) for order in names for x in order])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            parts = batch.column(0).to_pylist()
            every, good, toxic = (np.array(batch.column(i).to_pylist(), np.int64).reshape(len(parts), width) for i in (1, 2, 3))
            removed = every @ m["removed"]
            totals = np.stack([removed[:, own == i].sum(axis=1) for i in range(len(letters))], axis=1)
            counts = [every @ m["kept"], removed, every @ m["redundant"], every @ m["unique"], good @ m["removed"], toxic @ m["removed"], totals[:, own]]
            steps = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(parts, object), steps), pa.string()),
                    pa.array([x for x in names for _ in letters] * len(parts), pa.string()),
                    pa.array(np.tile(np.arange(steps) % len(letters) + 1, len(parts)).astype(np.int32)),
                    *(pa.array(c.ravel()) for c in counts),
                ],
                names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )

    return run


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    ship(docs)
    letters = "".join(text_filters(F.col("text"))) + "E"
    parts = histograms(document_masks(docs, id_col, text_col, part_col), labels, 1 << len(letters), id_col)
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return parts.mapInArrow(_product(letters), f"part string, filter_order string, step int, {counts}")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS copy
  FROM texts
),
fails AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, copy AS e
  FROM worded
),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
         || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
         count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL
),
grown AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || x FROM grown, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS letters(x) WHERE NOT contains(o, x)
),
steps AS (SELECT o AS filter_order, s::INTEGER AS step, o[s] AS own, o[1:s - 1] AS earlier FROM grown, range(1, 6) AS r(s) WHERE length(o) = 5),
placed AS (
  SELECT part, filter_order, step, own, failed, n, good, toxic, contains(failed, own) AS here,
         translate(failed, earlier, '') <> failed AS before
  FROM cells, steps
),
counted AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT before), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (here AND NOT before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND NOT before), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (here AND NOT before), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
