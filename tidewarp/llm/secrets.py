"""Secret scans with structural confirmation (operator 5).

Base kinds (assign, access, hex) are pattern matches. The structural kinds decode a candidate and parse it
before anything is reported:

* ``pem``: an armoured private key whose body decodes to a private-key encoding, or that its headers call
  encrypted by a cipher whose initial value and whole blocks it has; its line breaks may be escaped and its lines
  quoted by ``>``;
* ``jwt``: a signed token whose first part decodes to a JSON object naming an ``alg``, whose second part decodes
  to a JSON object and whose third part decodes to as many bytes as that algorithm's signatures have (any 16 or
  more for an unknown one; unsigned tokens aren't reported); it may follow other dotted parts;
* ``der``: a base64 or hex run that decodes to an ASN.1 private key whose nested lengths all fit;
* ``ssh``: a base64 run that decodes to an openssh-key-v1 container whose nested lengths all fit.

Base64 keys may be wrapped over lines, with line breaks or escaped ones, and indented. The lines joined are as many as the
key's own length asks for, so a key ends with its last line. The body of an armoured key is such a key too.

Each text is scanned whole, on its own; nothing is shuffled. Spans are in code points, end exclusive.

Defined cases: null text is empty. An empty text has no spans. Texts of any length are scanned whole. Ids (null
too) pass through; repeated rows give repeated results, in equal spans the longest of a kind at a place comes
last. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import table

KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
#: Fixed patterns of the base kinds and the least length of what they match.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
WORDS = ("passw", "secret", "token", "apikey", "api_key")

MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
ARMOURED = re.compile(r"(?:[A-Za-z0-9+/=\s:,>-]|\\+[nr/])*+")
#: What mails and notes put before each line of a text that they quote.
QUOTED = re.compile(r"(?m)^[ \t]*>[> \t]*")
ESCAPED_BREAK, ESCAPED_SLASH = re.compile(r"\\+[nr]"), re.compile(r"\\+/")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}")
RUN = "[A-Za-z0-9+/_-]"
#: The n or r of an escaped line break is no part of the run after it.
BASE64 = re.compile(rf"(?<!{RUN})(?:(?<=\\)[nr])?({RUN}{{40,}}={{0,2}})")
BREAK = r"(?:[ \t]*\r?\n[ \t]*|(?:\\+r)?\\+n[ \t]*)"
#: The first line of a wrapped key, by how a SEQUENCE and SSH_MAGIC begin in base64, and a line after it.
WRAPPED = re.compile(rf"[Mb](?:(?<!{RUN}[Mb])|(?<=\\[nr][Mb]))(?:(?<=M)[A-P]|(?<=b)3Bl){RUN}*+(?={BREAK}{RUN})")
LINE = re.compile(rf"{BREAK}({RUN}+)")
PADDING = re.compile("={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
SSH_MAGIC = b"openssh-key-v1\0"

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, with or without padding; None if it isn't."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill data exactly; None if a length does not fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_key(data: bytes | None) -> bool:
    """PKCS#1, DSA, SEC 1 or PKCS#8 private key (PKCS#8 encrypted too), by structure."""
    if not data or data[0] != SEQUENCE or len(data) < 24:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items or len(items) < 2:
        return False
    tags = [tag for tag, _ in items]
    if tags[0] == INTEGER and len(items[0][1]) == 1:
        if len(tags) >= 9 and tags[:9] == [INTEGER] * 9 and len(items[1][1]) >= 32:
            return True
        if tags == [INTEGER] * 6 and items[0][1] == b"\0" and len(items[1][1]) >= 64 and len(items[2][1]) >= 20:
            return True
        if tags[:2] == [INTEGER, OCTETS] and items[0][1] == b"\x01" and len(items[1][1]) >= 16:
            return True
        if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
            named = der_items(items[1][1])
            return bool(named and named[0][0] == OID) and len(items[2][1]) >= 16
    if tags == [SEQUENCE, OCTETS]:
        named = der_items(items[0][1])
        return bool(named and named[0][0] == OID) and len(items[1][1]) >= 16
    return False


def is_ssh_key(data: bytes | None) -> bool:
    """openssh-key-v1: cipher, kdf, options, count, that many public keys, private block; nothing left over."""
    if not data or not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= count <= 64 and all(field() is not None for _ in range(count + 1)) and at == len(data)


def stated(data: bytes) -> int:
    """The bytes that an encoded key takes, as far as data, its beginning, tells; more than data has until it tells all, 0 if it is no key."""
    if data[:1] == bytes([SEQUENCE]):
        if len(data) < 2 or data[1] < 0x80:
            return 2 + (data[1] if len(data) > 1 else 0)
        n = data[1] & 0x7F
        return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if len(data) >= 2 + n else 0) if 1 <= n <= 4 else 0
    if not data.startswith(SSH_MAGIC[: len(data)]):
        return 0
    at, left, counted = len(SSH_MAGIC), 3, False
    while at + 4 <= len(data):
        value, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if left:
            at, left = at + value, left - 1
        elif 1 <= value <= 64:
            left, counted = value + 1, True
        else:
            return 0
        if counted and not left:
            return at
    return at + 4


def wrapped_key(text: str, first: re.Match) -> tuple[str, int] | None:
    """(kind, end) of a key that begins with this line and takes whole lines."""
    body, at = first[0], first.end()
    while True:
        size = stated(decode64(body[: len(body) // 4 * 4]) or b"")
        chars = -(-size * 4 // 3)
        if not size or chars <= len(body):
            break
        lines, n = [body], len(body)
        while n < chars:
            line = LINE.match(text, at)
            if not line:
                return None
            lines.append(line[1])
            n, at = n + len(line[1]), line.end()
        body = "".join(lines)
    if not size or chars != len(body):
        return None
    data, end = decode64(body), PADDING.match(text, at).end()
    return ("der", end) if is_der_key(data) else ("ssh", end) if is_ssh_key(data) else None


#: Bytes of a signature by algorithm, from and to.
SIGNATURE = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)} | {
    f"{kind}{bits}": (128, 1024) for kind in ("RS", "PS") for bits in (256, 384, 512)
}
#: Block and initial value of the ciphers of armoured keys, in bytes.
CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
LEGACY = re.compile(r"\s*Proc-Type:\x204,ENCRYPTED\s+DEK-Info:\x20([A-Z0-9-]+),([0-9A-Fa-f]+)\s+([A-Za-z0-9+/=\s]+)")


def is_encrypted_key(text: str) -> bool:
    """The inside of an armoured key with the headers of an encrypted one: whole blocks of ciphertext and an initial value of one block."""
    found = LEGACY.fullmatch(text)
    block = CIPHERS.get(found[1]) if found else None
    data = decode64("".join(found[3].split())) if block else None
    return bool(data) and len(found[2]) == 2 * block and len(data) >= 64 and len(data) % block == 0


def is_token(head: str, body: str, signature: str) -> bool:
    named = ""
    for part, needs in ((head, "alg"), (body, None)):
        data = decode64(part)
        if not data or data.strip()[:1] != b"{":
            return False
        try:
            value = json.loads(data)
        except ValueError:
            return False
        if not isinstance(value, dict) or needs and not isinstance(value.get(needs), str):
            return False
        named = value[needs] if needs else named
    least, most = SIGNATURE.get(named, (16, 1024))
    return least <= len(decode64(signature) or b"") <= most


def armoured(text: str) -> list[tuple[int, str, int]]:
    """Spans of armoured keys: each end mark with the nearest mark before it, if that begins the same kind of key; a body is looked at once."""
    found, begun = [], None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
            continue
        if begun and begun[2] == m[2] and ARMOURED.fullmatch(text, begun.end(), m.start()):
            plain = text[begun.end() : m.start()]
            plain = ESCAPED_SLASH.sub("/", ESCAPED_BREAK.sub("\n", plain)) if "\\" in plain else plain
            plain = QUOTED.sub("", plain) if ">" in plain else plain
            data = decode64("".join(x for x in plain.split() if ":" not in x and "," not in x))
            if is_der_key(data) or is_ssh_key(data) or is_encrypted_key(plain):
                found.append((begun.start(), "pem", m.end()))
        begun = None
    return found


def tokens(text: str) -> list[tuple[int, str, int]]:
    """Spans of signed tokens: of a dotted run, each three parts in a row that no token before has taken."""
    found = []
    for m in DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            three = parts[i : i + 3]
            if len(three[0]) >= 10 and len(three[1]) >= 2 and is_token(*three):
                end = at + sum(map(len, three)) + 2
                found.append((at, "jwt", end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(three[0]) + 1, i + 1
    return found


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), sorted by start, then kind as in KINDS."""
    found: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), "hex", m.end()) for m in HEX_RUN.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += armoured(text)
    if "." in text:
        found += tokens(text)
    for m in BASE64.finditer(text):
        data = decode64(m[1])
        if is_der_key(data):
            found.append((m.start(1), "der", m.end()))
        elif is_ssh_key(data):
            found.append((m.start(1), "ssh", m.end()))
    done = 0
    for m in WRAPPED.finditer(text):
        if m.start() >= done and (key := wrapped_key(text, m)):
            found.append((m.start(), key[0], key[1]))
            done = key[1]
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0] in (m[0].lower(), m[0].upper()) and is_der_key(bytes.fromhex(m[0])):
            found.append((m.start(), "der", m.end()))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[0], rank[x[1]], x[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): found is an array of (kind, start, end) in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = [[{"kind": k, "start": s, "end": e} for s, k, e in spans(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "found"])

    rows = ship(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, found array<struct<kind:string,start:int,end:int>>")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin("assign", "access", "hex"))

    def joined(which):
        return F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def secret_base_counts(spark, sf_dir: str) -> DataFrame:
    """The numbers of op5's base kinds on their own, which SQL can tell as well."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_SQL = r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
       len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM documents
"""
