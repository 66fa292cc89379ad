"""Phrase collocation mining (operator 11).

Texts are cut at PIECE_ENDS into pieces and those into words; a phrase is 2 to ``longest`` words in a row within a piece.

1. Identical pieces of a language become one piece with a multiplicity (a map-side combined count), written
   once. Chunks of about CHUNK bytes of distinct pieces, chosen by hash, are what tasks work on from here.
2. Which n-grams can be frequent is found by numbers alone. A chunk adds up its own weighted words and pairs
   (numpy, over 64-bit hashes) and sends each hash bucket one message: 32-bit fingerprints and sums. The bucket
   adds up the messages and tells each chunk which of its fingerprints reach ``least``. Fingerprints that collide
   only let more n-grams through.
3. A chunk then sends the strings and sums of the words and pairs that may be frequent, and of the longer
   n-grams all of whose pairs may be, to the n-gram's hash bucket. There duckdb counts them, exactly and out
   of core: a bucket's messages stream into its table, which spills beyond MEMORY. A hot n-gram is one row a chunk.
4. Every part of a candidate is itself frequent, so it has been counted. A candidate sends a request for each of its
   parts to that part's count (parts that very many candidates ask for are broadcast, see common.join_hot), and
   the replies meet again by candidate, where the lowest-scoring cut wins.
5. A candidate inside a longer one of the same count is dropped. Counts never grow with length, so if any longer
   one has the count, one longer by one word has: each candidate tells its two parts that are one word shorter.

Phrases are counted as strings, never by hashes. Products are decimals of 38 digits.

duckdb spills into the shared folder where that is a path of the file system (local or mounted). Elsewhere it
has nowhere to spill that isn't machine-local; buckets then have to fit MEMORY, which their number (a bucket
for each BUCKET n-grams) sees to.

Defined cases: null text is empty, null language is ``und``. Pieces without words are none. Repeated rows
count each. Texts of any length are read whole. Fewer candidates than ``most`` are returned as they are; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import ascii_lower, cut, join_hot, scratch, table, text_or_empty

#: A piece ends at each of these.
PIECE_ENDS = "[.,;:!?\\n-\\r]"
#: Bytes of the distinct pieces of a chunk, about.
CHUNK = 6 << 20
#: N-grams of a bucket, about, and what duckdb may hold of them.
BUCKET = 1_500_000
MEMORY = "160MB"
#: Candidates of a language's group that is ranked in one task, about.
RANKED = 100_000

SUMS = "bucket long, chunk long, prints binary, n binary"
REPLIES = "bucket long, chunk long, prints binary"
STRINGS = "bucket long, grams binary"
COUNTS = "lang string, phrase string, f long"


def distinct_pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n, words): distinct pieces, words joined by single spaces, and how often they occur."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    pieces = docs.select(lang.alias("lang"), F.explode(F.split(ascii_lower(text_or_empty(text_col)), PIECE_ENDS)).alias("piece"))
    tidy = F.trim(F.when(F.col("piece").rlike("\t|  "), F.regexp_replace("piece", "[ \t]+", " ")).otherwise(F.col("piece")))
    counted = pieces.select("lang", tidy.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))
    spaces = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit(" ")))
    return cut(counted.withColumn("words", spaces + 1), "pieces")


#: Odd multipliers of the hash of an n-gram, from the one of its first words and the next word's.
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _LEFT + b * _RIGHT
    x ^= x >> np.uint64(31)
    x *= _LEFT
    return x ^ (x >> np.uint64(29))


def _hashed(strings: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


class _Chunk:
    """A chunk's words as numbers: ``code`` of each word, the row of ``pieces`` it is in, ``lang`` and weight of that row."""

    def __init__(self, pieces: pa.Table, bits: int):
        split = pc.split_pattern(pieces["piece"].combine_chunks(), " ")
        flat = split.flatten().dictionary_encode()
        langs = pieces["lang"].combine_chunks().dictionary_encode()
        self.words, self.langs, self.bits = flat.dictionary, langs.dictionary, bits
        self.code = flat.indices.to_numpy().astype(np.int32)
        row = np.repeat(np.arange(len(split), dtype=np.int32), np.diff(split.offsets.to_numpy()))
        self.lang = langs.indices.to_numpy().astype(np.int32)[row]
        self.weight = pieces["n"].to_numpy()[row]
        #: How many words of the piece are left from each word on, itself included.
        ends = np.cumsum(np.diff(split.offsets.to_numpy()))
        self.left = (ends[row] - np.arange(len(row))).astype(np.int32)

    def hashes(self, longest: int) -> list[np.ndarray]:
        """For each length 1 to ``longest`` the hashes of the n-grams that start at the words of starts(length)."""
        word = _hashed(self.words)[self.code]
        found = [_mixed(_hashed(self.langs)[self.lang], word)]
        for length in range(2, longest + 1):
            starts = self.starts(length)
            last = found[-1][np.searchsorted(self.starts(length - 1), starts)] if length > 2 else found[0][starts]
            found.append(_mixed(last, word[starts + length - 1]))
        return found

    def starts(self, length: int) -> np.ndarray:
        return np.flatnonzero(self.left >= length)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def prints(self, hashes: np.ndarray) -> np.ndarray:
        """32 bits after those of the bucket."""
        return (hashes >> np.uint64(32 - self.bits)).astype(np.uint32)


def _summed(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the sums of their weights, and where each of them is found."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64), order[first]


def _sums(bits: int, words: int):
    """A chunk's messages of its words and, with words = 2, pairs."""

    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        chunk = _Chunk(pieces, bits)
        hashes = chunk.hashes(words)
        found, n, _ = _summed(np.concatenate(hashes), np.concatenate([chunk.weight[chunk.starts(i + 1)] for i in range(words)]))
        buckets, first = np.unique(chunk.bucket(found), return_index=True)
        ends = np.append(first, len(found))[1:]
        prints = chunk.prints(found)
        spans = list(zip(first.tolist(), ends.tolist(), strict=True))
        return pa.table({"bucket": pa.array(buckets), "chunk": pa.array(np.full(len(spans), key[0].as_py(), np.int64)), "prints": pa.array([prints[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())})

    return run


def _replies(least: int):
    """What a bucket tells each chunk: its fingerprints that reach ``least`` over all chunks."""

    def run(key: tuple[pa.Scalar, ...], messages: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in messages["prints"].to_pylist()]
        found, n, _ = _summed(np.concatenate(sent), np.concatenate([np.frombuffer(x, np.int64) for x in messages["n"].to_pylist()]))
        found = found[n >= least]
        return pa.table({"bucket": messages["bucket"], "chunk": messages["chunk"], "prints": pa.array([np.intersect1d(x, found).tobytes() for x in sent], pa.binary())})

    return run


def _strings(bits: int, longest: int):
    """A chunk's n-grams that may be frequent, each once with its sum: a message of Arrow bytes for each bucket."""

    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(pieces, bits)
        hashes = chunk.hashes(longest)
        # Bucket and fingerprint in one number; each is below 2^32.
        known = [np.int64(b) << np.int64(32) | np.frombuffer(x, np.uint32).astype(np.int64) for b, x in zip(replies["bucket"].to_pylist(), replies["prints"].to_pylist(), strict=True)]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.int64)
        good = np.zeros(len(chunk.code), bool)
        grams, buckets = [], []
        for length, own in enumerate(hashes, 1):
            starts = chunk.starts(length)
            if length <= 2:
                number = chunk.bucket(own) << np.int64(32) | chunk.prints(own).astype(np.int64)
                at = np.searchsorted(known, number)
                fits = known[np.minimum(at, len(known) - 1)] == number if len(known) else np.zeros(len(number), bool)
                if length == 2:
                    good[starts] = fits
            else:
                fits = np.logical_and.reduce([good[starts + i] for i in range(length - 1)])
            starts, own = starts[fits], own[fits]
            grams.append(_distinct(chunk, starts, length))
            buckets.append(chunk.bucket(own[grams[-1].pop("at")]))
        found = pa.concat_tables([pa.table(g) for g in grams])
        bucket = np.concatenate(buckets)
        order = np.argsort(bucket, kind="stable")
        found, (places, first) = found.take(pa.array(order)), np.unique(bucket[order], return_index=True)
        ends = np.append(first, len(found))[1:]
        return pa.table({"bucket": pa.array(places), "grams": pa.array([_packed(found.slice(a, b - a)) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return run


def _distinct(chunk: _Chunk, starts: np.ndarray, length: int) -> dict:
    """lang, phrase and n of the distinct n-grams at ``starts``, and where in starts each is found."""
    number = chunk.lang[starts].astype(np.int64)
    for i in range(length):
        number = np.unique(number * len(chunk.words) + chunk.code[starts + i], return_inverse=True)[1]
    _, n, at = _summed(number, chunk.weight[starts])
    first = starts[at]
    parts = [chunk.words.take(pa.array(chunk.code[first + i])) for i in range(length)]
    phrase = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
    return {"lang": chunk.langs.take(pa.array(chunk.lang[first])), "phrase": phrase, "n": pa.array(n), "at": at}


def _packed(grams: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, grams.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(grams)
    return out.getvalue().to_pybytes()


def _bucket(least: int, folder: str | None):
    """(lang, phrase, f): the n-grams of buckets that reach ``least``, by duckdb. Rows are sorted by bucket."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        own = f"{folder}/{uuid.uuid4().hex}" if folder else ""
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own, "preserve_insertion_order": False})

        def counted() -> Iterator[pa.RecordBatch]:
            yield from con.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(n) >= {int(least)}").to_arrow_reader(10_000)
            con.execute("DROP TABLE grams")

        def fresh() -> None:
            con.execute("CREATE TABLE grams (lang VARCHAR, phrase VARCHAR, n BIGINT)")

        try:
            now = None
            for batch in source:
                for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if bucket != now:
                        if now is not None:
                            yield from counted()
                        fresh()
                        now = bucket
                    con.register("message", pa.ipc.open_stream(packed).read_all())
                    con.execute("INSERT INTO grams SELECT * FROM message")
                    con.unregister("message")
            if now is not None:
                yield from counted()
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return run


def _spill(path: str) -> str | None:
    """A folder of the shared ones as a path of the file system, None where it is none."""
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        return None
    os.makedirs(place.path, exist_ok=True)
    return place.path


def phrase_counts(pieces: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """(lang, phrase, f) of all words and phrases of up to ``longest`` words that occur ``least`` times in distinct_pieces()."""
    spark = ship(pieces).sparkSession
    size, words = pieces.agg(F.sum(F.octet_length("piece")), F.sum("words")).first()
    chunks = max(1, -(-(size or 0) // CHUNK))
    bits = min(31, max(0, 2 * (words or 0) // BUCKET).bit_length())
    dealt = pieces.select(F.pmod(F.xxhash64("lang", "piece"), F.lit(chunks)).alias("chunk"), "lang", "piece", "n")
    sums = dealt.groupBy("chunk").applyInArrow(_sums(bits, min(2, longest)), SUMS)
    replies = cut(sums.groupBy("bucket").applyInArrow(_replies(least), REPLIES), "phrase-replies")
    strings = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_strings(bits, longest), STRINGS)
    sorted_ = strings.repartition("bucket").sortWithinPartitions("bucket")
    return cut(sorted_.mapInArrow(_bucket(least, _spill(scratch(spark, "phrase-spill"))), COUNTS), "phrase-counts")


def _key(lang: Column, phrase: Column) -> Column:
    """One string for both; phrases have no tab."""
    return F.concat(phrase, F.lit("\t"), lang)


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of counts (lang, phrase, f), by the lowest-scoring cut; totals is (lang, n)."""
    long = counts.withColumn("parts", F.split("phrase", " ")).withColumn("width", F.size("parts")).where("width > 1")
    part = lambda start, size: F.array_join(F.slice("parts", start, size), " ")
    at = F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k")
    cuts = long.select("lang", "phrase", "parts", "width", at)
    sides = F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("width") - F.col("k")).alias("part")))
    asked = cuts.select("lang", "phrase", "k", F.explode(sides).alias("side")).select("lang", "phrase", "k", "side.first", _key(F.col("lang"), F.col("side.part")).alias("key"))
    asked = cut(asked, "phrase-requests")
    weights = asked.groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    known = weights.join(counts.select(_key(F.col("lang"), F.col("phrase")).alias("key"), "f"), "key")
    answered = join_hot(asked, known, "key", "asked", asked.count(), "phrase")
    side = lambda first: F.max(F.when(F.col("first") == F.lit(first), F.col("f")))
    parts = answered.groupBy("lang", "phrase", "k").agg(side(True).alias("l"), side(False).alias("r"))
    best = parts.groupBy("lang", "phrase").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))  # longest - 1 at most
    rows = long.select("lang", "phrase", F.col("f").alias("a")).join(best, ["lang", "phrase"])
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    rows = join_hot(rows, totals.join(per_lang, "lang").select("lang", "n", "rows"), "lang", "rows", long.count(), "phrase").drop("rows")
    score = F.expr("CAST(CAST(1000 * a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0)) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)) AS DECIMAL(38,0))")
    each = rows.select("lang", "phrase", "a", "n", F.explode("cuts").alias("cut")).select("lang", "phrase", "a", "n", "cut.k", "cut.l", "cut.r").withColumn("score", score)
    least = each.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return least.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def maximal(found: DataFrame) -> DataFrame:
    """found (lang, phrase, a, ...) without the phrases inside a longer one that occurs as often."""
    parts = F.split("phrase", " ")
    shorter = F.array(*(F.array_join(F.slice(parts, start, F.size(parts) - 1), " ") for start in (1, 2)))
    told = found.where(F.size(parts) > 2).select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return found.join(told, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank. A language's rows are ranked in groups first, of which the first ones meet."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    groups = max(16, -(-found.count() // RANKED))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return first.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases."""
    pieces = distinct_pieces(docs, text_col, lang_col)
    totals = pieces.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("n"))
    found = cut(maximal(scored(phrase_counts(pieces, least, longest), totals)), "collocations")
    return ranked(found, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents
),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, k
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded), range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)
),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM f WHERE k > 1
),
halves AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
  FROM cuts JOIN totals USING (lang)
  JOIN f AS x ON x.lang = cuts.lang AND x.phrase = list_aggregate(w[1:c], 'string_agg', ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.phrase = list_aggregate(w[c + 1:], 'string_agg', ' ')
),
lowest AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM lowest AS s
  WHERE NOT EXISTS (
    SELECT 1 FROM f AS t WHERE t.lang = s.lang AND t.k > s.k AND 100 * t.f >= 100 * s.a AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')
  )
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""
