"""WARC archives: writing, and reading with segment reassembly (operator 4).

Writing. Of pages with equal payloads (by SHA-256) the one with the largest id becomes a response record, the
others revisit records that name it. Payloads that very many pages share are looked up by broadcast, so no
task receives them all. A response's block is an HTTP response in chunked transfer framing; a block over
``segment_bytes`` goes into a first segment and continuation records, so a record is no longer than that and
its headers. Every record is a gzip member of its own; a file has so many that it stays below FILE_BYTES.
Spark's text writer writes the members (as bytes) with an empty gzip member between them for a line
separator, so any file system that Spark can write to will do.

Reading. A file is one row (files of 2 GB and more, from elsewhere, can't be read). Records that are whole are
decoded where they are read. All are dealt by origin identifier (a whole record's own) and sorted by it and by
segment number; a task joins segments one origin after the other, checks that none is missing and that their
length is the total that the last one states, and decodes the chunked framing. Revisits take their payload's
length from the record they refer to. Damage doesn't end the read: it gives rows with a problem (see read_archives()).

Defined cases: a null payload is empty; a null or empty url leaves out the target header. A null id is
written as such, read back as null, and never wins against an id. Repeated rows (same id and payload) are
all responses, or all revisits. Rows of one id with different payloads are records of their own. Payloads
shorter than ``least_revisit`` are all responses. An empty table gives empty archives and an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import cut, join_hot, scratch, table, text_or_empty
from .exact_dedup import sha256

SEGMENT = 64 << 10
#: The query's segments: small, so that most pages have several.
QUERY_SEGMENT = 2 << 10
CHUNK = 3 << 10
FILE_BYTES = 64 << 20
#: Bytes of a record's headers and framing, at most about.
HEADERS = 4 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


EMPTY_MEMBER = member(b"")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of chunked framing; sizes may have extensions, trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(data) or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk's length does not fit")
        out.append(data[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        return unchunked(body)
    size = fields.get(b"content-length")
    return body if size is None else body[: int(size)]


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'none' if page is None else page}:{digest}>"


def page_of(record: str) -> int | None:
    found = record.strip("<>").split(":")[2]
    return None if found == "none" else int(found)


def record(kind: str, ident: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment_bytes: int = SEGMENT) -> Iterator[bytes]:
    digest = digest32(payload)
    ident = record_id(page, digest)
    fields = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        yield record("revisit", ident, b"", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))])
        return
    block = HTTP + chunked(payload)
    fields.append(("Content-Type", "application/http; msgtype=response"))
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", ident, block, fields)
        return
    yield record("response", ident, parts[0], [*fields, ("WARC-Segment-Number", "1")])
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(i))]
        if i == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", f"{ident[:-1]}:{i}>", part, more)


#: How a gzip member begins: magic number and the one method there is.
GZIP = b"\x1f\x8b\x08"


def _member(data: memoryview, at: int, step: int) -> tuple[bytes, int]:
    """The plain bytes of the gzip member that begins here, fed in steps, and where it ends."""
    unpack, parts = zlib.decompressobj(31), []
    while not unpack.eof:
        if at >= len(data):
            raise ValueError("a gzip member is cut short")
        piece = data[at : at + step]
        parts.append(unpack.decompress(piece))
        at += len(piece) - len(unpack.unused_data)
    return b"".join(parts), at


def _members(data: bytes, step: int = 1 << 16) -> Iterator[bytes | str]:
    """The plain bytes of a file's gzip members, or the file itself; for a damaged stretch what is wrong, and then the next member that is whole."""
    if data[:2] != GZIP[:2]:
        yield data
        return
    view, at, told = memoryview(data), 0, False
    while 0 <= at < len(data):
        try:
            plain, at = _member(view, at, step)
            told = False
            yield plain
        except (ValueError, zlib.error) as problem:
            if not told:
                yield str(problem)
            told, at = True, data.find(GZIP, at + 1)


def _one(plain: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    for needed in ("warc-type", "warc-record-id", "content-length"):
        if needed not in head:
            raise ValueError(f"a record without {needed}")
    stop = end + 4 + int(head["content-length"])
    if plain[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit")
    return head, plain[end + 4 : stop], stop + 4


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """(headers by lower-case name, block) of the records in a file of gzip members or plain records.

    A damaged stretch gives one string, what is wrong with it; the records after it are found by the next
    member, or in plain files the next line that begins a record.
    """
    for plain in _members(data):
        if isinstance(plain, str):
            yield plain
            continue
        at, told = 0, False
        while 0 <= at < len(plain):
            try:
                head, block, at = _one(plain, at)
                told = False
                yield head, block
            except ValueError as problem:
                if not told:
                    yield str(problem)
                told = True
                at = plain.find(b"\r\nWARC/", at + 1)
                at = at + 2 if at >= 0 else at


def assemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length or None, part) in any order; equal numbers are the same segment."""
    by = {n: (total, part) for n, total, part in segments}
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError("a segment is missing")
    block = b"".join(by[n][1] for n in sorted(by))
    total = by[len(by)][0]
    if total is None or total != len(block):
        raise ValueError("the segments' total length does not fit")
    return block


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT,
                   least_revisit: int = 0, file_bytes: int = FILE_BYTES) -> None:
    rows = ship(pages).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(payload_col).alias("content"))
    rows = rows.withColumn("digest", sha256(F.col("content")))
    shared = rows.where(F.octet_length("content") >= least_revisit).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("pages"))
    # Groups of one need no look-up: only shared payloads are joined.
    best = cut(shared.where("pages > 1"), "warc-responses")
    total = best.agg(F.sum("pages")).first()[0] or 0
    marked = join_hot(rows, best, "digest", "pages", total, "id", "left").select("id", "url", "content", "keep_id", (F.col("pages") > 1).alias("shared"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out, size = [], 0
            for ident, url, text, keep, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = bool(common) and keep is not None and ident != keep
                for x in page_records(ident, url, text.encode(), keep, revisit, segment_bytes):
                    out.append(member(x))
                    size += len(out[-1])
                if size > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + HEADERS))).text(path)


READ = "record_type string, record_id string, url string, refers_to_id string, declared string, number int, total long, origin string, block binary, payload binary, payload_bytes long, payload_digest string, problem string"
_NAMES = [x.split()[0] for x in READ.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in READ.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _damaged(problem: str, ident: str | None = None, origin: str | None = None) -> tuple:
    return ("damaged", ident, None, None, None, None, None, origin or ident, None, None, None, None, problem)


def _parse(payloads: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for data in batch.column(0).to_pylist():
                out, size, stretches = [], 0, 0
                for found in records(data):
                    if isinstance(found, str):
                        # Without a record's id to go by, stretches are dealt by where they are found.
                        stretches += 1
                        out.append(_damaged(found, None, f"damaged:{len(data)}:{stretches}"))
                        continue
                    head, block = found
                    kind, number = head["warc-type"], head.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    common = (kind, head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-refers-to"), declared)
                    try:
                        if number is not None:
                            total = head.get("warc-segment-total-length")
                            out.append((*common, int(number), None if total is None else int(total), head.get("warc-segment-origin-id", common[1]), block, None, None, None, None))
                        elif kind == "revisit":
                            out.append((*common, None, None, common[1], None, None, None, declared, None))
                        else:
                            body = http_payload(block)
                            out.append((*common, None, None, common[1], None, body if payloads else None, len(body), digest32(body), None))
                    except ValueError as problem:
                        out.append(_damaged(str(problem), common[1]))
                    size += len(block)
                    if size > 32 << 20:
                        yield _table(out)
                        out, size = [], 0
                yield _table(out)

    return run


def _join_segments(payloads: bool):
    """Records from rows as READ, sorted by origin and number: whole ones as they are, others from their segments. A segment found again (from a repeated page) is held once."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, parts, heads = None, {}, []

        def joined() -> list[tuple]:
            if not parts:
                return []
            try:
                body = http_payload(assemble([(n, *x) for n, x in parts.items()]))
            except ValueError as problem:
                return [_damaged(str(problem), head[1]) for head in heads] or [_damaged(str(problem), origin)]
            return [(*head, None, None, None, None, body if payloads else None, len(body), digest32(body), None) for head in heads] or [_damaged("a segment is missing", origin)]

        for batch in source:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, ident, url, _, declared, number, total, own, block = row[:9]
                if own != origin:
                    out += joined()
                    origin, parts, heads = own, {}, []
                if number is None:
                    out.append(row)
                    size += len(row[9] or b"")
                    continue
                parts.setdefault(number, (total, block))
                if number == 1:
                    heads.append((kind, ident, url, None, declared))
                size += len(block)
                if size > 32 << 20:
                    yield _table(out)
                    out, size = [], 0
            yield _table(out)
        yield _table(joined())

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """A row per page record: record_type, record_id, page_id, url, refers_to, payload (null for revisits), payload_bytes, payload_digest, problem.

    What can't be read is a row too, of record_type damaged, with what is wrong as its problem and, where they are
    known, its ids: a stretch that is no record, a record whose segments or framing don't fit. A payload whose
    digest isn't the declared one, and a revisit of what was not read, keep their type and have a problem.
    All other records are read. With ``strict`` any problem is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = ship(files).mapInArrow(_parse(payloads), READ)
    joined = parsed.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_join_segments(payloads), READ)
    found = cut(joined.drop("number", "total", "origin", "block"), "warc-found")
    false = F.when(F.col("declared") != F.col("payload_digest"), F.lit("the payload's digest is not the declared one"))
    found = found.withColumn("problem", F.coalesce("problem", false))
    damaged = found.where("record_type = 'damaged'")
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'").withColumnRenamed("refers_to_id", "target")
    asked = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("asks"))
    sizes = responses.groupBy(F.col("record_id").alias("target")).agg(F.max("payload_bytes").alias("target_bytes"))
    known = cut(asked.join(sizes, "target"), "warc-targets")
    revisits = join_hot(revisits.drop("payload_bytes"), known, "target", "asks", known.agg(F.sum("asks")).first()[0] or 0, "record_id", "left")
    revisits = revisits.withColumnsRenamed({"target": "refers_to_id", "target_bytes": "payload_bytes"}).drop("asks")
    unread = F.when(F.col("refers_to_id").isNotNull() & F.col("payload_bytes").isNull(), F.lit("what it refers to was not read"))
    revisits = revisits.withColumn("problem", F.coalesce("problem", unread))
    page = lambda c: F.nullif(F.split_part(c, F.lit(":"), F.lit(3)), F.lit("none")).try_cast("long")
    out = responses.unionByName(revisits).unionByName(damaged).select(
        "record_type", "record_id", page(F.col("record_id")).alias("page_id"), "url", page(F.col("refers_to_id")).alias("refers_to"), "payload", "payload_bytes", "payload_digest", "problem"
    )
    if not strict:
        return out
    wrong = F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.coalesce("record_id", F.lit("a file"))))
    return out.withColumn("payload_digest", F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(wrong)).drop("problem")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, segment_bytes=QUERY_SEGMENT)
    return read_archives(spark, path, payloads=False, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
