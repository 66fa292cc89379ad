"""N-gram Jaccard join by vertical partitioning (operator 2).

Documents are sets of word n-grams (64-bit hashes); two link when their Jaccard similarity reaches a
threshold. Each text is read and hashed once; its sorted hashes are written and read from there.

1. Global order. N-grams whose hash lies below COUNTED are counted over all documents, the others where they
   repeat within a task's chunk of documents, which finds the very common ones. Those found once come first,
   uncounted ones next, repeated ones last, the commoner the later, each by hash. The repeated ones are kept
   in a bitmap a level, of at most ORDER_BITS bits each, whatever the input; a fuller bitmap takes n-grams
   found once for repeated ones. Any fixed order gives right results, so wrong bits cost time alone.
2. Candidates. Linked sets share an n-gram among the first n - ceil(t n) + 1 of each. Of those, n-grams found
   once can't be shared and are not sent. Documents that share one form a bucket. Of a bucket's pairs those
   may link whose sketches (parities of a set's hashes by bit) differ in no more bits than the sets of a
   linked pair could; the bucket sends a spanning forest of them. N-grams of SPLIT and more documents have
   their buckets split by document; the least document of each size class goes to every part.
3. Vertical partitioning, the only way that a pair is verified. The order of hashes is cut into FRAGMENTS
   ranges, every set into its segments. A task has the segments of one fragment for some candidate pairs, of
   whole families of them unless a family is large, and counts their partial overlaps; a shuffle sums them per
   pair, which gives the links.
4. What forests connect is a family; all documents of a split bucket are one. No link leaves a family. Where a
   family has several components of links, the documents outside its largest one are compared with those of
   other components, by sketches again, in blocks of BLOCK rows. Pairs of the same two components are sent in
   growing numbers, 16, 1024, ... until a link joins them or none is left, so a group of near copies is never
   expanded into all its pairs and no link between components is lost.
5. Components of all links; copies are linked with the least id of equal sets. Of equal sets only one takes
   part in steps 1 to 4: one a task by a table of its own, then one of all by a bitmap of ids, which when
   fuller lets more of them through.

Sets are compared by the hashes of their n-grams: a wrong count needs a collision within one pair.

Defined cases: null text, or no words, is an empty set, linked with nothing (its own component). Fewer words
than n give one n-gram of all of them. Null ids are linked with nothing and have a null component. Rows of
one id are one document for its component; each row has its own n_shingles. An empty table gives an empty
result. Extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import as_bytes, cut, drop_others, join_hot, table
from .components import components

CACHE = 100_000
#: Words of a set's sketch, by the size from which it has them.
SKETCH = ((0, 4), (300, 8), (800, 32), (3200, 128))
#: Bits of a bitmap; at most 16 MB each, as broadcast.
ORDER_BITS = 1 << 27
#: The share of n-grams, by hash, that are counted.
COUNTED = 0.25
REPEATED = 2
#: Counts from which an n-gram moves further to the end of the order.
LEVELS = (2, 32, 1024)
#: The count from which buckets are split in 8 parts; 8 times as many for each further power of 8.
SPLIT = 8192
FRAGMENTS = 4
#: N-grams of candidate pairs that one task has, over all fragments.
TASK_GRAMS = 2_000_000
#: Pairs of one document that meet in a task.
MATES = 256
#: Rows of a side that meet when components are compared.
BLOCK = 512
PENDING = 1_000_000

_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def grams(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    span = min(width, len(ids))
    h = np.full(n, span, np.uint64)
    for j in range(span):
        h = (h * _K) + ids[j : j + n]
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _least_overlap(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def _prefix(n: int, percent: int) -> int:
    return n - _least_overlap(n, percent) + 1


def _bit(key: Column, bits: int) -> tuple[Column, Column]:
    slot = key.bitwiseAND(F.lit(bits - 1))
    return F.call_function("shiftright", slot, F.lit(6)), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(keys: DataFrame, rows: int, most: int = ORDER_BITS) -> np.ndarray:
    """A bitmap over the low bits of a column named key; at most ``most`` bits, whatever the number of keys."""
    bits = min(most, max(1 << 10, 1 << (32 * max(1, rows)).bit_length()))
    word, bit = _bit(F.col("key"), bits)
    out = np.zeros(bits // 64, np.uint64)
    got = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _spread(ids: np.ndarray) -> np.ndarray:
    """Mixed ids, for a bitmap by low bits."""
    h = ids.astype(np.int64).view(np.uint64)
    return h ^ (h >> np.uint64(26))


def _id_bitmap(rows: DataFrame, n: int) -> np.ndarray:
    """A bitmap of ids, for rows to be looked up by _spread."""
    spread = F.col("id").bitwiseXOR(F.call_function("shiftrightunsigned", F.col("id"), F.lit(26)))
    return bitmap(rows.select(spread.alias("key")), n)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the number of hashes per bit; two sketches differ in at most as many bits as the sets differ in hashes."""
    words = [w for least, w in SKETCH if len(s) >= least][-1]
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _hashed(width: int):
    """(id, n, sig, own, sketch, grams): a row's set, its size and 128 bits that stand for it. Null ids, empty sets and copies of an earlier row have no grams of their own."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("ngram_join")
        seen: set[bytes] = set()
        for batch in source:
            ids = batch.column(0).to_pylist()
            texts = as_bytes(batch.column(1))
            for start in range(0, len(ids), 512):
                n, sig, own, bits, data = [], [], [], [], []
                for ident, x in zip(ids[start : start + 512], texts[start : start + 512], strict=True):
                    s = grams(x, width)
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    new = ident is not None and len(s) > 0 and sig[-1] not in seen
                    own.append(new)
                    if new and len(seen) < CACHE:
                        seen.add(sig[-1])
                    bits.append(sketch(s).tobytes() if new else None)
                    data.append(s.tobytes() if new else None)
                columns = [pa.array(ids[start : start + 512], pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(own, pa.bool_()), pa.array(bits, pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "sig", "own", "sketch", "grams"])
        _words.clear()

    return run


class _Bucketed:
    """Rows of buckets, sorted by key and size, and the pairs among them that may be linked."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], percent: int):
        self.n, self.percent = n.astype(np.int64), percent
        lengths = np.array([len(x) for x in sketches], np.int64) // 8
        flat = np.frombuffer(b"".join(sketches), np.uint64)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.levels = []
        for _, words in SKETCH:
            # Longer sketches fold into shorter ones by exclusive or of their parts.
            place = np.full(len(lengths), -1, np.int64)
            rows = np.flatnonzero(lengths >= words)
            place[rows] = np.arange(len(rows))
            table_ = np.zeros((len(rows), words), np.uint64)
            for size in np.unique(lengths[rows]).tolist():
                own = rows[lengths[rows] == size]
                parts = flat[start[own][:, None] + np.arange(size)[None, :]].reshape(len(own), size // words, words)
                table_[place[own]] = np.bitwise_xor.reduce(parts, axis=1)
            self.levels.append((place, table_))

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = self.n[a] + self.n[b]
        allowed = both - 2 * -(-self.percent * both // (100 + self.percent))
        good = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
        for place, table_ in self.levels:
            have = np.flatnonzero(good & (place[a] >= 0) & (place[b] >= 0))
            if len(have):
                far = np.bitwise_count(table_[place[a[have]]] ^ table_[place[b[have]]]).sum(axis=1, dtype=np.int64)
                good[have] &= far <= allowed[have]
        return good

    def forest(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may link, enough to connect all that do, of one bucket; no circles."""
        left, a, b = np.arange(first, last), [], []
        while len(left):
            edge, left = left[:1], left[1:]
            while len(edge) and len(left):
                hit = np.zeros(len(left), bool)
                for x in edge.tolist():
                    rest = np.flatnonzero(~hit)
                    own = rest[self.may_link(np.full(len(rest), x), left[rest])]
                    hit[own] = True
                    a.append(np.full(len(own), x))
                    b.append(left[own])
                edge, left = left[hit], left[~hit]
        return np.concatenate(a or [left]), np.concatenate(b or [left])

    def forests(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for many buckets of one small size: a pair is left out if an earlier row may link with both."""
        x, y = np.tril_indices(size, -1)
        rows, mates = (starts[:, None] + x).ravel(), (starts[:, None] + y).ravel()
        near = np.zeros((len(starts), size, size), np.float32)
        near[:, x, y] = self.may_link(rows, mates).reshape(len(starts), len(x))
        bucket, row, mate = np.nonzero((near > 0) & (near @ near.transpose(0, 2, 1) == 0))
        return starts[bucket] + mate, starts[bucket] + row


def _same_before(*columns: np.ndarray) -> np.ndarray:
    """Whether a row equals the one before in all columns."""
    return np.append(False, np.logical_and.reduce([c[1:] == c[:-1] for c in columns]))


def _whole_runs(source: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that rows that are equal in the first ``keys`` columns, which are sorted, stay together."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        last = [batch.column(j)[batch.num_rows - 1] for j in range(keys)]
        differs = np.flatnonzero(np.logical_or.reduce([batch.column(j).to_numpy() != x.as_py() for j, x in enumerate(last)]))
        if not len(differs):
            if held and any(held[-1].column(j)[0] != x for j, x in enumerate(last)):
                yield _one(held)
                held = []
            held.append(batch)
            continue
        whole = int(differs[-1]) + 1
        yield _one([*held, batch.slice(0, whole)])
        held = [batch.slice(whole)]
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _compatible(percent: int):
    """(a, b, n): forests of what may link in each bucket, n n-grams in a and b. Rows (key, sub, n, id, sketch) are sorted so."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(source, 2):
            k, sub, n, i = (batch.column(j).to_numpy() for j in range(4))
            rows = _Bucketed(n, batch.column(4).to_pylist(), percent)
            starts = np.flatnonzero(~_same_before(k, sub))
            lengths = np.diff(np.append(starts, len(k)))
            pairs = []
            for size in np.unique(lengths[lengths > 1]).tolist():
                own = starts[lengths == size]
                if size <= 16:
                    pairs += [rows.forests(own[x : x + 4096], size) for x in range(0, len(own), 4096)]
                else:
                    pairs += [rows.forest(at, at + size) for at in own.tolist()]
            if not pairs:
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            a, b = a[i[a] != i[b]], b[i[a] != i[b]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[a], i[b])), pa.array(np.maximum(i[a], i[b])), pa.array(n[a].astype(np.int64) + n[b])], names=["a", "b", "n"])

    return run


_EDGE = np.uint64(int(COUNTED * 2.0**64))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _counted(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)].view(np.int64)), pa.array(counts[i : i + (1 << 18)])], names=["key", "n"])


def _of(ids, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose id, in the first column, is in a bitmap."""
    return batch.filter(pa.array(in_bitmap(ids.value, _spread(batch.column(0).to_numpy()))))


def _gram_counts(ids):
    """(key, n): the n-grams below the edge, and above it those that repeat in a chunk, combined before they are sent."""

    def chunk(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        sent = (key < _EDGE) | (n >= REPEATED)
        return _counted(key[sent], n[sent])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("ngram_join")
        held, size = [], 0
        for batch in source:
            for data in _of(ids, batch).column(1).to_pylist():
                held.append(np.frombuffer(data, np.uint64))
                size += len(held[-1])
                if size > PENDING:
                    yield from chunk(held)
                    held, size = [], 0
        if size:
            yield from chunk(held)

    return run


def _repeats(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the n-grams counted at least REPEATED times; a key's rows are in one partition."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size, after = 0, PENDING
    for batch in source:
        keys.append(batch.column(0).to_numpy().view(np.uint64))
        counts.append(batch.column(1).to_numpy())
        size += batch.num_rows
        if size > after:
            key, n = _summed(keys, counts)
            keys, counts, size = [key], [n], len(key)
            after = 2 * size + PENDING
    if size:
        key, n = _summed(keys, counts)
        yield from _counted(key[n >= REPEATED], n[n >= REPEATED])


def _prefixes(percent: int, levels, unsplit: int, members):
    """(key, sub, subs, n, id): the prefixes in the global order without n-grams found once; sub of subs parts of the key's bucket."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = levels.value
        for batch in source:
            batch = _of(members, batch)
            ids, sizes, lengths, keys, parts = [], [], [], [], []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(data, np.uint64)
                level = np.zeros(len(s), np.int8)
                at = np.arange(len(s))
                for bits in maps:
                    at = at[in_bitmap(bits, s[at])]
                    level[at] += 1
                low, rest = s < _EDGE, _prefix(len(s), percent)
                rest -= int(np.count_nonzero(low & (level == 0)))
                take = 0
                for own in (~low & (level == 0), *(level == x + 1 for x in range(len(maps)))):
                    if rest <= 0:
                        break
                    keys.append(s[own][:rest])
                    parts.append(level[own][:rest])
                    rest -= len(keys[-1])
                    take += len(keys[-1])
                if take:
                    ids.append(ident)
                    sizes.append(len(s))
                    lengths.append(take)
            if ids:
                own = np.repeat(np.array(ids, np.int64), lengths)
                subs = np.left_shift(1, 3 * np.maximum(0, np.concatenate(parts).astype(np.int64) - unsplit))
                sub = (_spread(own) * _K >> np.uint64(20)).astype(np.int64) % subs
                columns = np.concatenate(keys).view(np.int64), sub.astype(np.int32), subs.astype(np.int32), np.repeat(np.array(sizes, np.int32), lengths), own
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sub", "subs", "n", "id"])

    return run


def _shared(percent: int):
    """Of rows (key, sub, subs, n, id), sorted so, those that share key and sub with one whose size allows a link, and all of split keys.

    Rows are sorted by size: if the next one is too large, so are all after it.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the last row, if it is alone so far; key, sub and size of the last row
        for batch in source:
            if not batch.num_rows:
                continue
            batch = _one([held, batch]) if held is not None else batch
            k, sub, subs, n = (batch.column(j).to_numpy() for j in range(4))
            n = n.astype(np.int64)
            same = _same_before(k, sub) & np.append(False, 100 * n[:-1] >= percent * n[1:])
            keep = same | np.append(same[1:], False) | (subs > 1)
            if held is None and last is not None:
                keep[0] |= (k[0], sub[0]) == last[:2] and 100 * last[2] >= percent * n[0]
            held, last = (None if keep[-1] else batch.slice(batch.num_rows - 1)), (k[-1], sub[-1], n[-1])
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _buckets(percent: int):
    """What _shared() leaves, with a hash of a bucket's rows for its key, unless it is split.

    Near copies meet under most of their n-grams, so many buckets have the same rows; those become one by distinct().
    Two different ones of one hash would be one bucket with the rows of both, which loses no link.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(_shared(percent)(source), 2):
            k, sub, subs, n, i = (batch.column(j).to_numpy() for j in range(5))
            n = n.astype(np.int64)
            starts = np.flatnonzero(~(_same_before(k, sub) & np.append(False, 100 * n[:-1] >= percent * n[1:])))
            h = (i.astype(np.int64).view(np.uint64) * _K) ^ n.view(np.uint64)
            for m in (_M1, _M2):
                h = h * m
                h ^= h >> np.uint64(33)
            rows = np.repeat(np.add.reduceat(h, starts), np.diff(np.append(starts, len(k)))).view(np.int64)
            columns = np.where(subs > 1, k, rows), np.where(subs > 1, sub, 0).astype(np.int32), subs, n.astype(np.int32), i
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sub", "subs", "n", "id"])

    return run


def _segments(wanted, fragments: int):
    """(id, fragment, sig, n, grams): the segments, by equal hash ranges, of the rows (id, sig, n, grams) whose id may be wanted."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)
        for batch in source:
            batch = _of(wanted, batch)
            rows = []
            for ident, sig, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(data, np.uint64)
                for i, part in enumerate(np.split(s, np.searchsorted(s, edges))):
                    rows.append((ident, i, xxhash.xxh3_64_intdigest(sig) >> 1, n, part.tobytes()))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "fragment", "sig", "n", "grams"])

    return run


OVERLAP = "fragment int, a long, b long, variant long, n_a int, n_b int, overlap int"


def _partial(percent: int):
    """The overlap in one fragment of each pair of its bucket, unless the fragment differs in more than the sets of a linked pair could."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in OVERLAP.split(", ")]

    def run(key: tuple, segments: pa.Table, pairs: pa.Table) -> pa.Table:
        segments = segments.sort_by("id")
        ids, sig, n = (segments.column(c).to_numpy() for c in ("id", "sig", "n"))
        data = [np.frombuffer(x, np.uint64) for x in segments.column("grams").to_pylist()]
        size = np.array([len(x) for x in data], np.int64)
        # Each segment of a with each of b: an id has several where its rows have different texts.
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        sides = []
        for x in (a, b):
            first, end = np.searchsorted(ids, x), np.searchsorted(ids, x, "right")
            sides.append((first, end - first))
        (at_a, n_a), (at_b, n_b) = sides
        each = n_a * n_b
        pair = np.repeat(np.arange(len(a)), each)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        left, right = at_a[pair] + step // np.maximum(1, n_b[pair]), at_b[pair] + step % np.maximum(1, n_b[pair])
        good = 100 * np.minimum(n[left], n[right]).astype(np.int64) >= percent * np.maximum(n[left], n[right]).astype(np.int64)
        left, right = left[good], right[good]
        # Hashes by rank, so that (segment, hash) is one sorted number.
        flat = np.concatenate(data) if len(data) else np.zeros(0, np.uint64)
        values, rank = np.unique(flat, return_inverse=True)
        held = np.repeat(np.arange(len(data)), size) * max(1, len(values)) + rank
        starts = np.cumsum(size) - size
        overlap = np.zeros(len(left), np.int64)
        for begin, end in _chunks(size[right], PENDING // 2):
            take = size[right[begin:end]]
            of = np.repeat(np.arange(begin, end), take)
            item = rank[np.repeat(starts[right[begin:end]] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
            wanted = left[of] * max(1, len(values)) + item
            place = np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))
            overlap += np.bincount(of[held[place] == wanted], minlength=len(left)) if len(held) else 0
        both = n[left].astype(np.int64) + n[right]
        allowed = both - 2 * -(-percent * both // (100 + percent))
        keep = size[left] + size[right] - 2 * overlap <= allowed
        left, right, overlap = left[keep], right[keep], overlap[keep]
        columns = np.full(len(left), key[1].as_py()), ids[left], ids[right], sig[left] ^ (sig[right] >> 1), n[left], n[right], overlap
        return pa.Table.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``most`` in all."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


def fragment_overlaps(
    pairs: DataFrame, sets: DataFrame, percent: int, fragments: int = FRAGMENTS, task_grams: int = TASK_GRAMS, families: DataFrame | None = None
) -> DataFrame:
    """(fragment, a, b, variant, n_a, n_b, overlap) of pairs (a, b, n): partial overlaps, before they are summed.

    All pairs of a family (node, component) go to one task, so a document is sent once, whatever its number of
    pairs. Families of more n-grams than half a task's are dealt by a, and where a has very many, MATES pairs at a time.
    """
    spark = pairs.sparkSession
    total, rows = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(total / task_grams))
    mates = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count(F.lit(1)) / MATES).alias("parts"), F.sum("n").alias("own"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0)
    place = F.xxhash64("a", part)
    if families is not None:
        mates = mates.join(families.select("node", "component"), F.col("of") == F.col("node"), "left").withColumn("family", F.coalesce("component", "of"))
        whole = mates.groupBy("family").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("weight"))
        mates = join_hot(mates.select("of", "parts", "family"), whole, "family", "weight", rows, "of")
        mates = mates.select("of", "parts", F.when(F.col("all") <= task_grams // 2, F.col("family")).alias("home"))
        place = F.when(F.col("home").isNotNull(), F.xxhash64("home")).otherwise(place)
    dealt = pairs.join(mates, F.col("a") == F.col("of")).select(F.pmod(place, F.lit(buckets)).alias("bucket"), "a", "b")
    dealt = cut(dealt, "candidate-pairs")
    need = cut(dealt.select("bucket", F.col("a").alias("id")).unionByName(dealt.select("bucket", F.col("b").alias("id"))).distinct(), "candidate-documents")
    wanted = spark.sparkContext.broadcast(_id_bitmap(need, need.count()))
    cutter = _segments(wanted, fragments)
    segments = sets.select("id", "sig", F.col("n").cast("int").alias("n"), "grams").mapInArrow(cutter, "id long, fragment int, sig long, n int, grams binary").join(need, "id")
    placed = dealt.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    keys = ["bucket", "fragment"]
    return segments.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(_partial(percent), OVERLAP)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, families: DataFrame | None = None) -> DataFrame:
    """Of candidate pairs (a, b, n) those whose partial overlaps sum to a link."""
    summed = fragment_overlaps(pairs, sets, percent, families=families).groupBy("a", "b", "variant", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return summed.where(100 * F.col("overlap") >= percent * union).select("a", "b").distinct()


def _across(percent: int, allowance: int):
    """(a, b, n, more): pairs of different components that may link, ``allowance`` at most for two components of a block, and whether there are more.

    Rows (family, i, j, side, n, id, component, sketch) are sorted so; those of side 0 meet those of side 1, which
    do the same elsewhere, so the lesser id is the one that counts, and those of side 2.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(source, 3):
            columns = [batch.column(j).to_numpy() for j in range(7)]
            starts = np.flatnonzero(~_same_before(*columns[:3]))
            _, _, _, side, n, ids, component = columns
            rows = _Bucketed(n, batch.column(7).to_pylist(), percent)
            for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                edge = first + int(np.count_nonzero(side[first:end] == 0))
                found = []
                for x in range(first, edge):
                    mates = edge + np.flatnonzero((component[edge:end] != component[x]) & ((side[edge:end] == 2) | (ids[edge:end] > ids[x])))
                    mates = mates[rows.may_link(np.full(len(mates), x), mates)]
                    if len(mates):
                        found.append((np.full(len(mates), x), mates))
                if not found:
                    continue
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                two = np.stack([np.minimum(component[a], component[b]), np.maximum(component[a], component[b])])
                _, group = np.unique(two, axis=1, return_inverse=True)
                order = np.argsort(group.ravel(), kind="stable")
                group = group.ravel()[order]
                kept = np.arange(len(a)) - np.searchsorted(group, group) < allowance
                more = np.bincount(group)[group[kept]] > allowance
                a, b = a[order[kept]], b[order[kept]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(n[a].astype(np.int64) + n[b]), pa.array(more)], names=["a", "b", "n", "more"]
                )

    return run


def _apart(rows: DataFrame, labels: DataFrame, percent: int, allowance: int, block: int) -> DataFrame:
    """Pairs (a, b, n, more) across components, in the families of rows (family, id, n, sketch).

    In a family, documents of its largest component needn't meet each other, so one side is the rest.
    """
    known = rows.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = known.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("family").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("all")).where("k > 1")
    blocks = lambda x: F.ceil(x / F.lit(block)).cast("int")
    mixed = mixed.select("family", F.col("most.component").alias("major"), blocks(F.col("all") - F.col("most.c")).alias("rest"), blocks(F.col("all")).alias("whole"), F.col("all").alias("weight"))
    mixed = cut(mixed, "mixed-families")
    held = join_hot(known, mixed, "family", "weight", mixed.agg(F.sum("weight")).first()[0] or 0, "id")
    place = lambda blocks: F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    columns = ["family", "i", "j", "side", "n", "id", "component", "sketch"]
    minor = F.col("component") != F.col("major")
    left = held.where(minor).withColumns({"i": place(F.col("rest")), "j": every(F.col("whole")), "side": F.lit(0)}).select(*columns)
    right = held.withColumns({"i": every(F.col("rest")), "j": place(F.col("whole")), "side": F.when(minor, 1).otherwise(2)}).select(*columns)
    dealt = left.unionByName(right).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "n", "id")
    return dealt.mapInArrow(_across(percent, allowance), "a long, b long, n long, more boolean")


def _order(sets: DataFrame, ids, levels: tuple[int, ...], split: int) -> list[np.ndarray]:
    """The bitmaps of n-grams found at least as often as each level says, then at least split, 8 split, 64 split, ... times."""
    counted = sets.select("id", "grams").mapInArrow(_gram_counts(ids), "key long, n long").repartition("key")
    often = cut(counted.mapInArrow(_repeats, "key long, n long"), "repeated-grams")
    levels = [*levels, *(split << 3 * i for i in range(12))]
    sizes = often.agg(*(F.sum((F.col("n") >= x).cast("long")) for x in levels)).first()
    return [bitmap(often.where(F.col("n") >= x).select("key"), n) for x, n in zip(levels, sizes, strict=True) if n]


def _links(sets: DataFrame, ids, percent: int, levels: tuple[int, ...] = LEVELS, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(a, b): enough of the linked pairs of sets (id, n, sig, sketch, grams) to connect all that are linked. Sets whose id isn't in the bitmap are copies."""
    maps = _order(sets, ids, levels, split)
    shared_maps = sets.sparkSession.sparkContext.broadcast(maps)
    index = sets.select("id", "grams").mapInArrow(_prefixes(percent, shared_maps, len(levels), ids), "key long, sub int, subs int, n int, id long")
    parted = index.repartition("key", "sub").sortWithinPartitions("key", "sub", "subs", "n", "id")
    shared = cut(parted.mapInArrow(_buckets(percent), "key long, sub int, subs int, n int, id long").distinct(), "shared-grams")
    rows, together = shared.select("key", "sub", "n", "id"), None
    if len(maps) > len(levels):
        # The least document of each size class goes to all parts of a split bucket.
        parts = shared.where("subs > 1")
        of_size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.08)))
        least = parts.groupBy("key", "subs", of_size.alias("size")).agg(F.min(F.struct("n", "id")).alias("x"))
        rows = rows.unionByName(least.select("key", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.col("x.n").alias("n"), F.col("x.id").alias("id"))).distinct()
        whole = cut(parts.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("weight")), "split-buckets")
        together = join_hot(parts.select("key", F.col("id").alias("b")), whole, "key", "weight", whole.agg(F.sum("weight")).first()[0] or 0, "b").select("a", "b").distinct()
        together = cut(together, "split-families")
    sketches = sets.select("id", F.col("n").cast("int").alias("n"), "sketch")
    met = rows.join(sketches, ["id", "n"]).select("key", "sub", "n", "id", "sketch").repartition("key", "sub").sortWithinPartitions("key", "sub", "n", "id")
    forests = met.mapInArrow(_compatible(percent), "a long, b long, n long")
    tested = cut(forests.groupBy("a", "b").agg(F.max("n").alias("n")), "pairs")
    near = cut(components(tested), "near")
    links = cut(_verified(tested, sets, percent, near), "links")

    failed = cut(tested.join(links, ["a", "b"], "left_anti").select("a", "b"), "pairs-apart")
    tested = tested.select("a", "b")
    loose = failed if together is None else failed.unionByName(together)
    if loose.isEmpty():
        return links
    families = near
    if together is not None:
        families = cut(components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(together)), "families")
    open_ = families.join(loose.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    rows = families.join(open_, "component").select(F.col("component").alias("family"), F.col("node").alias("id"))
    rows = cut(rows.join(sketches, "id").select("family", "id", "n", "sketch"), "open-families")
    allowance = 16
    while True:
        found = cut(_apart(rows, components(links), percent, allowance, block), "pairs-across")
        new = cut(found.groupBy("a", "b").agg(F.max("n").alias("n")).join(tested, ["a", "b"], "left_anti"), "pairs")
        if not new.isEmpty():
            links = cut(links.unionByName(_verified(new, sets, percent, families)), "links")
            tested = cut(tested.unionByName(new.select("a", "b")), "tested")
        if found.where("more").isEmpty():
            return links
        allowance *= 64


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                       levels: tuple[int, ...] = LEVELS, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id), a row per row of docs."""
    spark = docs.sparkSession
    with_ids = ship(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    described = cut(with_ids.mapInArrow(_hashed(width), "id long, n long, sig binary, own boolean, sketch binary, grams binary"), "ngram-sets")
    full = described.where("n > 0 AND id IS NOT NULL").select("id", "sig", "own")
    groups = full.groupBy("sig").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("own"), F.col("id"))).alias("id"))
    groups = cut(groups, "equal-sets")
    ids = spark.sparkContext.broadcast(_id_bitmap(groups, groups.count()))
    links = _links(described.where("own"), ids, percent, levels, split, block)
    copies = groups.where("rows > 1").drop("id")
    twin = join_hot(full.select("id", "sig"), copies, "sig", "rows", copies.agg(F.sum("rows")).first()[0] or 0, "id")
    labels = components(links.unionByName(twin.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))))
    out = described.select("id", "n").join(labels, F.col("id") == F.col("node"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each group of linked documents, all columns; rows with a null id stay."""
    found = jaccard_components(docs, width, percent, id_col, text_col)
    gone = found.where("id <> component_id").select(F.col("id").alias("__tw_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__tw_gone"), "left_anti")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85).withColumnRenamed("id", "doc_id")


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams
  FROM w
), g AS (
  SELECT doc_id, unnest(grams) AS gram FROM s WHERE doc_id IS NOT NULL
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * overlap >= 85 * (len(x.grams) + len(y.grams) - overlap)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT a AS node, b AS other FROM e
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other
), c AS (
  SELECT node, min(other) AS low FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(least(c.low, s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.node = s.doc_id
"""
