"""Harmonic packing of documents into sequences of a fixed capacity (operator 6).

A document's ids are cut into whole sequences as long as they last. What remains (r of C ids) is cut by
reciprocal capacities: class k has slots of C // k ids and its bins take exactly k pieces. The largest
slot that fits in r is cut off until the rest has at least SMALL slots to a bin; the rest goes uncut to its
own class k = C // r, where bins of k such pieces are at least k / (k + 1) full. Each map task fills its
bins on its own and closes one when its count is reached.

Words recur, so their ids are looked up where the tokenizer file's own sections show that it splits texts at
white space and into WORD's words; any other tokenizer encodes whole texts.

The open bins that tasks end with (some classes of fewer than k pieces each) are joined in groups of tasks:
their ids are laid end to end and cut at the capacity, the last sequence of a group into powers of two,
which need no padding. A group's ids are at most CARRY tasks times SMALL + C // SMALL bins.

Defined cases: null text is empty and has the end id alone. Ids (null too) pass through; repeated rows are
packed each. Texts of any length are cut. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import cut, remember, table

CAPACITY = 4096
SMALL = 32
CARRY = 16
END_ID = 2
CACHE = 900_000

#: Characters on which the word rule below and the tokenizer's own splitting could differ: control and odd
#: spaces, superscripts and fractions, the dotted capital I, special-token marks, and all beyond U+024F.
ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\xb2\xb3\xb9\xbc-\xbeİɐ-\U0010ffff]|<\\|")
#: The pre-tokenizer's pattern (a fixed value of the tokenizer file) for the characters that ODD leaves.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")

#: The sections of a tokenizer file for which words can be looked up by the rule above.
PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def looks_up(path: str) -> bool:
    """Whether a tokenizer file splits texts the way that WORD does, and draws nothing at random."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    return all(made.get(k) == v for k, v in PLAIN.items()) and not made["model"].get("dropout")


_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. Words recur, so their ids are looked up; odd texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.plain = looks_up(path)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        remember("packing", _loaded.clear)
        return _loaded[path]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain or ODD.search(text):
            return self.whole(text)
        # No token spans white space, so what stands between it is looked up whole.
        runs = text.lower().split()
        missing = set(runs).difference(self.known)
        if missing:
            if len(self.known) + 2 * len(missing) > CACHE:
                self.known.clear()
                missing = set(runs)
            self._learn({run: WORD.findall(run) for run in missing})
        return b"".join(map(self.known.__getitem__, runs))

    def _learn(self, runs: dict[str, list[str]]) -> None:
        words = list({w for ws in runs.values() for w in ws}.difference(self.known))
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = array("I", found.ids).tobytes()
        for run, ws in runs.items():
            if run not in self.known:
                self.known[run] = b"".join(map(self.known.__getitem__, ws))


def slots(length: int, capacity: int = CAPACITY, small: int = SMALL) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of so many ids, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= small or k * rest == capacity:
            out.append((k, rest))
            break
        out.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    return out


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _fill(path: str, capacity: int, end_id: int | None):
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.at(path), TaskContext.get().partitionId()
        bins: dict[int, list[tuple]] = {}
        made, out = 0, []
        for batch in source:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + tail
                total, start = len(ids) // 4, 0
                for k, length in slots(total, capacity):
                    own = bins.setdefault(k, [])
                    own.append((ident, start, length, total, ids[4 * start : 4 * (start + length)]))
                    start += length
                    if len(own) == k:
                        offset = 0
                        for doc, begin, n, all_ids, data in own:
                            out.append((doc, begin, n, zlib.crc32(data), all_ids, part << 32 | made, offset, None))
                            offset += n
                        made += 1
                        own.clear()
                if len(out) >= 8192:
                    yield _batch(out)
                    out = []
        out += [(doc, begin, n, None, all_ids, None, part, data) for own in bins.values() for doc, begin, n, all_ids, data in own]
        if out:
            yield _batch(out)

    return run


def _lengths(total: int, capacity: int) -> np.ndarray:
    """Full sequences, then the rest in powers of two, largest first."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1], np.int64)


def _join_open(capacity: int):
    def run(key: tuple, table_: pa.Table) -> pa.Table:
        rows = sorted(table_.to_pylist(), key=lambda r: (r["offset"], r["length"], -1 if r["id"] is None else r["id"], r["start"]))
        ends = np.cumsum(_lengths(sum(r["length"] for r in rows), capacity))
        out, at, number, begin = [], 0, 0, 0
        for r in rows:
            used = 0
            while used < r["length"]:
                n = int(min(r["length"] - used, ends[number] - at))
                data = r["ids"][4 * used : 4 * (used + n)]
                out.append((r["id"], r["start"] + used, n, zlib.crc32(data), r["doc_tokens"], 1 << 62 | key[0].as_py() << 32 | number, at - begin, None))
                used, at = used + n, at + n
                if at == ends[number]:
                    number, begin = number + 1, at
        return pa.Table.from_batches([_batch(out)])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = ship(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    placed = rows.mapInArrow(_fill(tokenizer, capacity, end_id), SCHEMA)
    # The open pieces need the same evaluation as the closed ones, so both are written once.
    placed = cut(placed, "packing-pieces")
    left = placed.where("sequence_id IS NULL").withColumn("carry", F.floor(F.col("offset") / CARRY).cast("long"))
    joined = left.groupBy("carry").applyInArrow(_join_open(capacity), SCHEMA)
    return placed.where("sequence_id IS NOT NULL").unionByName(joined).drop("ids")


def op6_harmonic_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")
