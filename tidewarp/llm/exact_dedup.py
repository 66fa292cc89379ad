"""Exact de-duplication (operator 8): skew-safe combining over full content.

1. Each map task combines its own equal texts (the partial half of the first aggregate).
2. What is left goes to (digest, text, salt) groups; the salt is the map partition's number modulo
   ``salts``, so a text that a third of all rows share meets in ``salts`` groups of at most
   partitions/salts rows, never in one of all its rows.
3. The salt winners are combined per (digest, text).

Every stage groups by the text itself beside its digest, so texts whose digests collide stay apart.
Members find their winner by digest alone, unless the winners show a digest with several texts; rows of
such digests, and only those, are told apart by their text. Digests that very many rows share are looked up by
broadcast (see join_hot), so no task receives all members of a group.

Defined cases: null text equals ''. Null ids count in the group's size and never win against an id; a
group with null ids only keeps a null id. Repeated rows (same id, same text) are the same document: each
carries the same result; keep_one keeps one of them, of rows that differ in other columns the one with the least
hash over all columns. Texts of any length are compared whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_hot, text_or_empty


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(rows: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, content, keep_id, group_size) from rows of (id, digest, content)."""
    local = rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
    salted = local.groupBy("digest", "content", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size. Equal texts share the largest id as keep_id."""
    content = normalise(text_or_empty(text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), content.alias("content")).withColumn("digest", digest(F.col("content")))
    best = cut(winners(rows, salts).select("digest", "keep_id", "group_size"), "exact-winners")
    total = best.agg(F.sum("group_size")).first()[0] or 0
    members = lambda best: join_hot(rows.select("id", "digest"), best, "digest", "group_size", total, "id")
    shared = best.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        return members(best).select("id", "digest", "keep_id", "group_size")
    several = cut(shared, "exact-collisions")
    alone = members(best.join(several, "digest", "left_anti"))
    own = rows.join(several, "digest", "left_semi")
    apart = own.join(winners(own, salts), ["digest", "content"])
    return alone.unionByName(apart.drop("content")).select("id", "digest", "keep_id", "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """docs without exact copies, all columns; of equal texts the largest id stays, and once only."""
    content = ascii_lower(text_or_empty(text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), content.alias("content")).withColumn("digest", sha256(F.col("content")))
    best = cut(winners(rows, salts).select(F.col("digest").alias("__tw_best"), F.col("keep_id").alias("__tw_keep")), "exact-winners")
    # Nulls as a column of their own, so that the window and the join share one shuffle of the texts.
    known = lambda x: (F.coalesce(x.cast("string"), F.lit("")), x.isNull())
    keys = ["__tw_digest", "__tw_id", "__tw_null"]
    marked = docs.withColumns(dict(zip(keys, (sha256(content), *known(F.col(f"`{id_col}`"))), strict=True)))
    # Copies of a repeated row are cut to one a task before the shuffle, by the limit that Spark infers from row_number() = 1.
    same = Window.partitionBy(*keys).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    once = marked.withColumn("__tw_row", F.row_number().over(same)).where("__tw_row = 1")
    best = best.select("__tw_best", *(c.alias(n) for c, n in zip(known(F.col("__tw_keep")), ("__tw_keep_id", "__tw_keep_null"), strict=True)))
    met = (F.col("__tw_digest") == F.col("__tw_best")) & (F.col("__tw_id") == F.col("__tw_keep_id")) & (F.col("__tw_null") == F.col("__tw_keep_null"))
    return once.join(best, met, "left_semi").drop(*keys, "__tw_row")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
