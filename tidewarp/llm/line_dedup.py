"""Line de-duplication with two Bloom filters (operator 7).

1. Hash pass: each map task sends the 64-bit hashes of its documents' line keys, each once a chunk of
   documents, cut by hash into slices of about SLICE_LINES lines over all chunks.
2. A slice's task has the filter of once-seen hashes, sized by the slice's lines, and keeps those hashes that
   the filter has seen before. Only they make the twice-seen filter, sized by their number up to
   ``max_filter_bytes``, which is what is broadcast: 64 MB have 16 bits for each of 32 million repeated lines.
   A fuller filter (by computation 8 % of the lines seen once are suspected at 10^8 repeated lines, 64 % at
   3 * 10^8) only lets more lines be suspected; the result stays exact.
3. Suspected keys, and only those, are shuffled with their document; the smallest id holding a key owns it
   (a map-side combined minimum, so a key in very many documents is one row a task).
4. A document drops its suspected lines that it doesn't own. A key that the filter suspected wrongly is
   owned by its only document, so it stays there. No key is ever joined with all its documents, and no
   document without a suspected line is shuffled.

Defined cases: null or empty text is one empty line. A row with a null id is a document that can't own a line:
it loses the lines that an id holds, and those that only such rows hold stay in all of them. Repeated rows
(same id) are one document, each row with its own text. Texts of any length are read whole. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import BLANK, as_bytes, cut, table

HASHES = 4
FLUSH = 1_000_000
#: Lines of a slice, about, up to MOST_SLICES slices; beyond, slices grow to MOST_LINES lines before there are more.
SLICE_LINES = 1 << 18
MOST_SLICES = 4096
MOST_LINES = 1 << 24
#: Parts of the broadcast filter.
RANGES = 64


def line_keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys, None for keys of fewer than ``least`` code points."""
    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for key in text.lower().split(b"\n"):
        key = key.strip(BLANK)
        n = len(key)
        if n < least or (n < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
            keys.append(None)
        else:
            keys.append(key)
    return lines, keys


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES positions for each hash; bits is a power of two."""
    step = (hashes >> np.uint64(29)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (hashes[None, :] + i * step[None, :]) & np.uint64(bits - 1)


class Bloom:
    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def add(self, hashes: np.ndarray) -> None:
        at = _slots(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _slots(hashes, self.bits)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of a power of two of equal ranges of hashes; ranges may be 1."""
    return (hashes >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)


def _hash_pass(least: int):
    """(n, once, twice): a chunk's sorted hashes of lines that one of its documents holds, and that several do."""

    def packed(once: set[int], twice: set[int]) -> pa.RecordBatch:
        sides = [np.sort(np.fromiter(x, np.uint64, len(x))).tobytes() for x in (once - twice, twice)]
        return pa.RecordBatch.from_arrays([pa.array([len(once)], pa.int64()), *(pa.array([x], pa.binary()) for x in sides)], names=["n", "once", "twice"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[int] = set()
        twice: set[int] = set()
        for batch in source:
            for text in as_bytes(batch.column(0)):
                own = {xxhash.xxh3_64_intdigest(k) for k in line_keys(text, least)[1] if k is not None}
                twice |= own & once
                once |= own
                if len(once) >= FLUSH:
                    yield packed(once, twice)
                    once, twice = set(), set()
        if once:
            yield packed(once, twice)

    return run


def _sliced(slices: int):
    """(slice, once, twice): the chunks' hashes by slice."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for once, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sides = []
                for data in (once, twice):
                    hashes = np.frombuffer(data, np.uint64)
                    sides.append(np.split(hashes, np.searchsorted(_range_of(hashes, slices), np.arange(1, slices))))
                used = [i for i in range(slices) if len(sides[0][i]) or len(sides[1][i])]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array([x[i].tobytes() for i in used], pa.binary()) for x in sides)], names=["slice", "once", "twice"])

    return run


def _again(bits: int):
    """(range, n, hashes): a slice's hashes that its filter has seen before, each once. Rows are sorted by slice."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, again = None, None, []

        def sent() -> Iterator[pa.RecordBatch]:
            found = np.unique(np.concatenate(again)) if again else np.zeros(0, np.uint64)
            at = _range_of(found, RANGES)
            for i in np.unique(at).tolist():
                own = found[at == i]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["range", "n", "hashes"])

        for batch in source:
            for at, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != now:
                    yield from sent()
                    now, seen, again = at, Bloom(bits), []
                ones, twos = np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
                again += [ones[seen.has(ones)], twos]
                seen.add(ones)
                seen.add(twos)
        yield from sent()

    return run


def _filters(bits: int):
    """(range, bits): the twice-seen filter of a range of hashes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Bloom] = {}
        for batch in source:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filters.setdefault(at, Bloom(bits)).add(np.frombuffer(data, np.uint64))
        for at, found in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found.data.tobytes()], pa.binary())], names=["range", "bits"])

    return run


class Suspects:
    """The twice-seen filter, as broadcast."""

    def __init__(self, bits: int, data: dict[int, bytes]):
        self.bits = bits
        self.data = np.zeros(RANGES * bits // 8, np.uint8)
        for at, part in data.items():
            self.data[at * bits // 8 : (at + 1) * bits // 8] = np.frombuffer(part, np.uint8)

    def of(self, keys: list[bytes | None]) -> np.ndarray:
        """Which keys are suspected."""
        hashes = np.fromiter((0 if k is None else xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = _slots(hashes, self.bits) + (_range_of(hashes, RANGES) * self.bits).astype(np.uint64)[None, :]
        found = ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
        return found & np.fromiter((k is not None for k in keys), bool, len(keys))


def _power(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, n - 1).bit_length()


def twice_seen(texts: DataFrame, least: int, slice_lines: int, max_filter_bytes: int) -> Suspects:
    """The filter of keys that more than one document may hold."""
    hashed = cut(texts.mapInArrow(_hash_pass(least), "n long, once binary, twice binary"), "line-hashes")
    total = hashed.agg(F.sum("n")).first()[0] or 0
    slices = _power(min(-(-total // slice_lines), max(MOST_SLICES, -(-total // MOST_LINES))))
    sliced = hashed.select("once", "twice").mapInArrow(_sliced(slices), "slice long, once binary, twice binary")
    sliced = sliced.repartition("slice").sortWithinPartitions("slice")
    again = cut(sliced.mapInArrow(_again(max(64, _power(16 * -(-total // slices)))), "range long, n long, hashes binary"), "line-repeats")
    repeated = again.agg(F.sum("n")).first()[0] or 0
    bits = max(64, min(_power(16 * repeated // RANGES), _power(max_filter_bytes * 8 // RANGES + 1) // 2))
    filters = again.select("range", "hashes").repartition("range").mapInArrow(_filters(bits), "range long, bits binary")
    return Suspects(bits, {x["range"]: bytes(x["bits"]) for x in filters.collect()})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, slice_lines: int = SLICE_LINES, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """(id, n_lines, n_dropped, kept): kept is the text without lines that a smaller id holds as well."""
    spark = docs.sparkSession
    rows = ship(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    filters = spark.sparkContext.broadcast(twice_seen(rows.select("text"), least, slice_lines, max_filter_bytes))
    result = "id long, n_lines long, n_dropped long, kept string"

    def suspected(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, keys = [], []
            for ident, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own = line_keys(text, least)[1]
                found = {own[i] for i in np.flatnonzero(filters.value.of(own))}
                keys += found
                ids += [ident] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])

    def some(dirty: bool):
        """The rows with a suspected line, or the results of those without."""

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                counts, mine = [], []
                for text in as_bytes(batch.column(1)):
                    keys = line_keys(text, least)[1]
                    counts.append(len(keys))
                    mine.append(bool(filters.value.of(keys).any()) == dirty)
                own = batch.filter(pa.array(mine, pa.bool_()))
                if dirty:
                    yield own
                else:
                    counts = [n for n, m in zip(counts, mine, strict=True) if m]
                    kept = pc.fill_null(own.column(1), "")
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(counts, pa.int64()), pa.array([0] * len(counts), pa.int64()), kept], names=["id", "n_lines", "n_dropped", "kept"])

        return run

    def dropped(owned: bool):
        """Results from (id, text, keys): of the suspected lines, those that are (or are not) among the keys stay."""

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                total, fewer, kept = [], [], []
                for text, mine in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    lines, keys = line_keys(text, least)
                    mine = set(mine or ())
                    gone = {i for i in np.flatnonzero(filters.value.of(keys)).tolist() if (keys[i] in mine) != owned}
                    total.append(len(lines))
                    fewer.append(len(gone))
                    kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(fewer, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_lines", "n_dropped", "kept"])

        return run

    known, none = rows.where("id IS NOT NULL"), rows.where("id IS NULL")
    least_ids = known.mapInArrow(suspected, "id long, key binary").groupBy("key").agg(F.min("id").alias("owner"))
    held = none.isEmpty()
    if not held:
        least_ids = cut(least_ids, "line-owners")
    owners = least_ids.groupBy("owner").agg(F.collect_list("key").alias("keys"))
    dirty = known.mapInArrow(some(True), "id long, text string").join(owners, F.col("id") == F.col("owner"), "left").select("id", "text", "keys")
    out = known.mapInArrow(some(False), result).unionByName(dirty.mapInArrow(dropped(True), result))
    if held:
        return out
    # Rows without an id are numbered, and each looks up its own suspected keys.
    numbered = cut(none.select(F.monotonically_increasing_id().alias("id"), "text"), "line-no-ids")
    lost = numbered.mapInArrow(suspected, "id long, key binary").join(least_ids.select("key"), "key").groupBy("id").agg(F.collect_list("key").alias("keys"))
    apart = numbered.join(lost.withColumnRenamed("id", "row"), F.col("id") == F.col("row"), "left").select("id", "text", "keys")
    return out.unionByName(apart.mapInArrow(dropped(False), result).withColumn("id", F.lit(None).cast("long")))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
