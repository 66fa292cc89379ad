"""Mixing sources to target weights by Poisson replication (operator 9), DataFrame functions only.

A source's rate is the number of times its text has to be repeated, on average, for the mixture to reach
its weight: rate = weight * total / mass, where mass is the source's bytes and total the mixture's. Each
row draws a uniform number from md5(seed:id) and inverts the Poisson distribution of its source's rate, so
the draw depends on the row alone, not on its place, and needs no shuffle. Rows are exploded by their
count and shuffled globally by a hash of (seed, id, copy).

A source's probabilities are computed on their own, by Stirling's series, from 12 standard deviations below
its rate to 12 above, which no 52-bit draw leaves, and summed by a window: the work grows as the square root
of the rate, and no count is capped. What every row is joined with is its source's sums, 24 sqrt(rate) numbers;
a source with a high rate has few rows. All sources' sums are broadcast up to BROADCAST_BYTES and joined by a
salted key beyond. Copies are exploded in two steps, so that no array has more than COPIES entries.

Defined cases: a null source is a source of its own; null text has 0 bytes; a null id hashes as ''. A
source with no bytes has rate 0. Rows with equal id get equal counts. Sources without a weight (where
weights are given) have rate 0. An empty table gives an empty result. Extra columns are kept; those named like
the added ones (``__tw_...``) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bits, table, text_or_empty

#: Rates tables up to this size are broadcast; larger ones are joined by a salted key.
BROADCAST_BYTES = 64 << 20
COPIES = 4096
ADDED = ("__tw_rate", "__tw_copies", "__tw_copy", "__tw_key", "__tw_u", "__tw_first", "__tw_cum", "__tw_source", "__tw_batch", "__tw_salt", "__tw_salt0")


def _first(rate: Column) -> Column:
    """The least number of copies with a probability that counts."""
    return F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 40)).cast("long")


def _last(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("long")


def _log_p(k: Column, rate: Column) -> Column:
    """The logarithm of P(X = k). Beyond 20, k! is by Stirling's series and terms that nearly cancel are taken together."""
    x = F.greatest(k, F.lit(21)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    far = x * F.log1p((rate - x) / x) + (x - rate) - 0.5 * F.log(2 * math.pi * x) - series
    near = k * F.log(rate) - rate - F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))
    return F.when(k <= 20, near).otherwise(far)


def cumulative(rates: DataFrame) -> DataFrame:
    """rates (source, mass, rate) with first and cumulative: P(X <= first + i) for i = 0, 1, ..."""
    rate = F.col("rate")
    some = rates.where(rate > 0).withColumn("first", _first(rate))
    points = some.withColumn("k", F.explode(F.sequence("first", _last(rate)))).withColumn("p", F.exp(_log_p(F.col("k"), rate)))
    summed = points.withColumn("cum", F.sum("p").over(Window.partitionBy("source").orderBy("k")))
    lists = summed.groupBy("source", "mass", "rate", "first").agg(F.array_sort(F.collect_list(F.struct("k", "cum"))).alias("all"))
    lists = lists.select("source", "mass", "rate", "first", F.transform("all", lambda x: x["cum"]).alias("cumulative"))
    none = rates.where(~(rate > 0)).select("source", "mass", "rate", F.lit(0).cast("long").alias("first"), F.array(F.lit(1.0)).alias("cumulative"))
    return lists.unionByName(none)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total_bytes: int | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, mass, rate, first, cumulative). Weights default to equal shares, total_bytes to the input's bytes."""
    mass = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(F.octet_length(text_or_empty(text_col)).cast("long")).alias("mass"))
    mass = cut(mass, "mixing-mass")
    sums = mass.agg(F.sum("mass"), F.sum(F.when(F.col("mass") > 0, 1).otherwise(0))).first()
    total, filled = float(total_bytes or sums[0] or 0), max(1, sums[1] or 0)
    if weights is None:
        weight = F.lit(1.0 / filled)
    else:
        scale = float(sum(weights.values()))
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(v / scale))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    rate = F.when(F.col("mass") > 0, weight * F.lit(total) / F.col("mass")).otherwise(F.lit(0.0))
    return cut(cumulative(mass.withColumn("rate", rate)), "mixing-rates")


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, total_bytes: int | None = None,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", salts: int = 64, order: bool = True) -> DataFrame:
    """docs' columns with __tw_rate, __tw_copies, __tw_copy (from 1) and __tw_key, which the result is sorted by."""
    rates = source_rates(docs, weights, total_bytes, source_col, text_col)
    size = rates.agg(F.sum(8 * F.size("cumulative") + 64)).first()[0] or 0
    rates = rates.select(F.col("source").alias("__tw_source"), F.col("rate").alias("__tw_rate"), F.col("first").alias("__tw_first"), F.col("cumulative").alias("__tw_cum"))
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    docs = docs.drop(*ADDED)
    drawn = docs.withColumn("__tw_u", (hash_bits(ident, 52) + 0.5) / F.lit(float(1 << 52)))
    same = F.col(f"`{source_col}`").eqNullSafe(F.col("__tw_source"))
    if size <= BROADCAST_BYTES:
        joined = drawn.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__tw_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        drawn = drawn.withColumn("__tw_salt0", F.pmod(F.xxhash64("__tw_u"), F.lit(salts)).cast("int"))
        joined = drawn.join(salted, same & (F.col("__tw_salt0") == F.col("__tw_salt"))).drop("__tw_salt", "__tw_salt0")
    counted = joined.withColumn("__tw_copies", F.col("__tw_first") + F.size(F.filter("__tw_cum", lambda c: c < F.col("__tw_u")))).drop("__tw_cum", "__tw_first", "__tw_source", "__tw_u")
    batches = counted.where("__tw_copies > 0").withColumn("__tw_batch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tw_copies"), F.lit(COPIES).cast("long"))))
    last = F.least(F.col("__tw_batch") + (COPIES - 1), F.col("__tw_copies"))
    copies = batches.withColumn("__tw_copy", F.explode(F.sequence(F.col("__tw_batch"), last))).drop("__tw_batch")
    keyed = copies.withColumn("__tw_key", hash_bits(F.concat_ws(":", ident, F.col("__tw_copy").cast("string"))))
    if not order:
        return keyed
    return keyed.orderBy("__tw_key", F.col(f"`{id_col}`"), "__tw_copy")


def op9_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = poisson_mix(docs, seed=42)
    return mixed.select(
        "doc_id", "source", F.round("__tw_rate", 9).alias("rate"), F.col("__tw_copies").cast("int").alias("copies"), F.col("__tw_copy").cast("int").alias("copy"), F.col("__tw_key").alias("shuffle_key")
    )


OP9_SQL = """
WITH m AS (
  SELECT source, sum(octet_length(encode(coalesce(text, ''))))::DOUBLE AS mass FROM documents GROUP BY source
), r AS (
  SELECT source, CASE WHEN mass > 0 THEN (1.0::DOUBLE / (SELECT count(*) FROM m WHERE mass > 0)) * (SELECT sum(mass) FROM m) / mass ELSE 0 END AS rate FROM m
), p AS (
  SELECT source, rate, k, exp(-rate + CASE WHEN rate > 0 THEN k * ln(rate) ELSE 0 END - lgamma(k + 1)) AS p
  FROM r, range(0, 1000) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40) AND (rate > 0 OR k = 0)
), c AS (
  SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM p
), l AS (
  SELECT source, rate, list(cum ORDER BY k) AS cums FROM c GROUP BY source, rate
), d AS (
  SELECT d.doc_id, d.source, l.rate,
         len(list_filter(l.cums, lambda x: x < (('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE))::INT AS copies
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source
), e AS (
  SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM d WHERE copies > 0
)
SELECT doc_id, source, round(rate, 9) AS rate, copies, copy,
       ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM e
"""
