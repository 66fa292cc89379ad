"""Sharding by extendible hashing (operator 3), DataFrame functions only.

A directory is indexed by the leading bits of a key's hash. One aggregate gives the bytes of each cell
(prefix of a fixed number of bits); the bytes of all shorter prefixes follow from the cells. A shard is the
shortest prefix whose rows fit the limit, so only oversized buckets split, each on its next bit. Cells
that are still oversized go on for further bits, over their own rows only. Rows that share all 60 bits
of the key's hash (one key on very many rows) go on with 60 bits of a hash over key, text and the row's number
among equal ones, so a hot key splits too, the same way whatever files or partitions the rows are in.

The directory has at most 2**MOST_BITS entries a round, whatever the input.

Defined cases: null text has 0 bytes; a null key hashes as ''. A row that alone exceeds the limit gets a
shard of its own (oversized true), as would rows whose second hashes are equal in all 60 bits. An empty table gives an empty result. Repeated rows count each. Extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bits, table, text_or_empty

WIDTH = 60
MOST_BITS = 18


def _prefix(depth: F.Column | int) -> F.Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col("h"), (F.lit(WIDTH) - depth).cast("int"))


def _directory(rows: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """Leaves below depth base (at base = 0 the root too), each spread over the cells of depth base + bits."""
    deep = base + bits
    cells = rows.groupBy(_prefix(deep).alias("cell")).agg(F.sum("n_bytes").alias("size"), F.count(F.lit(1)).alias("n"))
    lowest = base + 1 if base else 0
    at = cells.select("cell", "size", "n", F.explode(F.sequence(F.lit(lowest), F.lit(deep))).alias("depth"))
    up = F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int"))
    nodes = cut(at.groupBy("depth", up.alias("prefix")).agg(F.sum("size").alias("size"), F.sum("n").alias("n")), "shard-nodes")
    fits = (F.col("size") <= limit) | (F.col("n") == 1)
    over = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    child = nodes.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    below = child.join(over, ["depth", "parent"], "left_semi").drop("parent")
    leaves = below.unionByName(nodes.where(F.col("depth") == lowest)).where(fits | (F.col("depth") == deep)).distinct()
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(deep) - F.col("depth")).cast("int"))
    first = F.col("prefix") * span
    return leaves.select(
        F.explode(F.sequence(first, first + span - 1)).alias("cell"),
        F.col("depth").alias("shard_depth"),
        F.col("prefix").alias("shard_prefix"),
        F.col("size").alias("shard_bytes"),
        F.col("n").alias("shard_docs"),
    )


def _split(rows: DataFrame, limit: int, bits: int, step: int, last: bool = False) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows with their shards, and rows whose WIDTH bits are used up; with last these keep their shard."""
    done, base = [], 0
    while True:
        bits = min(bits, WIDTH - base)
        directory = cut(_directory(rows, base, bits, limit), "shard-directory")
        # The first directory has at most 2**MOST_BITS entries.
        joined = rows.join(directory if base else F.broadcast(directory), _prefix(base + bits) == F.col("cell")).drop("cell")
        again = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
        if last and base + bits == WIDTH:
            return [*done, joined], None
        done.append(joined.where(~again))
        if directory.where(again).isEmpty():
            return done, None
        rows = cut(joined.where(again).select(*rows.columns), "shard-over")
        base += bits
        if base == WIDTH:
            return done, rows
        bits = step


def _numbered(rows: DataFrame, salts: int = 64) -> DataFrame:
    """rows with ``number``: 0, 1, 2, ... among rows of equal key and text, which are counted in ``salts`` groups."""
    held = cut(rows.withColumn("salt", F.spark_partition_id() % salts), "shard-hot")
    same = ["key", "digest"]
    counts = held.groupBy(*same, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*same).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).select(*(F.col(c).alias(f"of_{c}") for c in (*same, "salt")), "before")
    own = F.row_number().over(Window.partitionBy(*same, "salt").orderBy("n_bytes"))
    numbered = held.withColumn("own", own)
    matched = numbered.join(starts, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("digest") == F.col("of_digest")) & (F.col("salt") == F.col("of_salt")))
    return matched.withColumn("number", F.col("before") + F.col("own") - 1).select(*rows.columns, "number")


def extendible_shards(docs: DataFrame, limit_bytes: int = 512 << 20, key: str = "doc_id", text_col: str = "text", step: int = 12, keep: bool = False) -> DataFrame:
    """(key, n_bytes, shard_round, shard_depth, shard_prefix, shard_bytes, shard_docs, oversized), a row per row.

    A shard is named by (shard_round, shard_depth, shard_prefix); round 1 holds rows of a hot key. With keep
    the columns of docs follow in a struct named row.
    """
    content = text_or_empty(text_col)
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep else []
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.octet_length(content).cast("long").alias("n_bytes"), F.xxhash64(content).alias("digest"), *kept)
    rows = rows.withColumn("h", hash_bits(F.col("key")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 4))
    done, left = _split(rows, limit_bytes, bits, step)
    parts = [(0, x) for x in done]
    if left is not None:
        again = F.concat_ws(":", F.col("key").cast("string"), F.col("digest").cast("string"), F.col("number").cast("string"))
        again = cut(_numbered(left).withColumn("h", hash_bits(again)).drop("number"), "shard-hot")
        parts += [(1, x) for x in _split(again, limit_bytes, bits, step, last=True)[0]]
    out = None
    for number, part in parts:
        part = part.select(
            F.col("key").alias(key), "n_bytes", F.lit(number).alias("shard_round"), "shard_depth", "shard_prefix", "shard_bytes", "shard_docs",
            (F.col("shard_bytes") > limit_bytes).alias("oversized"), *(["row"] if keep else []),
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_shards(docs: DataFrame, path: str, limit_bytes: int = 512 << 20, key: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet, a folder ``shard=<round>-<depth>-<prefix>`` for each shard; a shard is one task's, so one file unless files are limited.

    Where docs have a column of the folder's name (in any case), it is ``shard_1`` or the first such name that is free.
    """
    taken = {c.lower() for c in docs.columns}
    folder = next(x for x in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if x not in taken)
    found = extendible_shards(docs, limit_bytes, key, text_col, keep=True)
    name = F.concat_ws("-", F.col("shard_round").cast("string"), F.col("shard_depth").cast("string"), F.lpad(F.hex("shard_prefix"), 15, "0"))
    found.select("row.*", name.alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


#: The query's shard size: small enough that the least table has several shards.
QUERY_LIMIT = 256 << 10


def op3_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), QUERY_LIMIT)


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), lvl AS (
  SELECT doc_id, n_bytes, depth::INT AS shard_depth, h >> (60 - depth)::INT AS shard_prefix
  FROM d, range(0, 41) t(depth)
), sized AS (
  SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs
  FROM lvl WINDOW w AS (PARTITION BY shard_depth, shard_prefix)
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shard_depth) AS r
  FROM sized WHERE shard_bytes <= {QUERY_LIMIT} OR shard_docs = 1
)
SELECT doc_id, n_bytes, 0 AS shard_round, shard_depth, shard_prefix, shard_bytes::BIGINT AS shard_bytes, shard_docs,
       shard_bytes > {QUERY_LIMIT} AS oversized
FROM leaf WHERE r = 1
"""
