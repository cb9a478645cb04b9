"""Secrets in texts, found by form and confirmed by structure (operator 3).

Base kinds are found by their form alone: assignments, access keys, long hex runs.
The method adds kinds that are reported only once their content has been decoded and
parsed:

* ``jwt``: a signed token: header and payload are base64url JSON objects, the header
  names an algorithm, the signature decodes (and may be empty only for ``none``);
* ``der``: base64 or hex whose bytes are one ASN.1 sequence with consistent nested
  lengths and the fields of a private key (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1);
  base64 may be wrapped over lines, as in PEM;
* ``openssh``: base64 of an ``openssh-key-v1`` container whose nested lengths add up.

Where a key in base64 ends is read from its own lengths, so whatever stands before or below
it, other keys too, is neither taken for a part of it nor hides it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import map_batches, text_or_empty

# The base kinds, in the order that breaks ties of equal starts.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "der", "openssh")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# Base64 of an ASN.1 sequence begins with M and A to P, that of the OpenSSH container with b3Bl.
KEY_START = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3Bl)")
# A run of base64, or several of them on lines of their own.
ENCODED = re.compile(r"[A-Za-z0-9+/]+(?:\r?\n[A-Za-z0-9+/]+)*")
LINE = re.compile(r"[A-Za-z0-9+/]+")
PADDING = re.compile(r"={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> Iterator[Span]:
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield Span("assign", *m.span())
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield Span("access", *m.span())
    for m in HEX.finditer(text):
        yield Span("hex", *m.span())


def _url64(part: str) -> bytes | None:
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    raw = _url64(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    """Whether ``header.payload.signature`` is a signed token by its content."""
    header, payload, signature = text.split(".")
    fields = _json_object(header)
    if not fields or not isinstance(fields.get("alg"), str) or _json_object(payload) is None:
        return False
    if not signature:
        return fields["alg"].lower() == "none"
    return _url64(signature) is not None and len(signature) >= 16


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the ASN.1 element at ``at``; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``at`` to ``end`` without a gap."""
    out = []
    while at < end:
        found = _element(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_private_key(data: bytes) -> bool:
    """Whether bytes are one DER private key, lengths consistent at every level read."""
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    fields = _fields(data, outer[1], outer[2])
    if not fields:
        return False
    tags = [f[0] for f in fields]

    def algorithm(field) -> bool:
        inner = _fields(data, field[1], field[2]) if field[0] == SEQUENCE else None
        return bool(inner) and inner[0][0] == OID and inner[0][2] > inner[0][1]

    def number(field) -> int:
        return int.from_bytes(data[field[1] : field[2]], "big") if field[2] > field[1] else -1

    if tags[:9] == [INTEGER] * 9 and number(fields[0]) in (0, 1):  # PKCS#1: n, e, d, p, q and the rest
        return fields[1][2] - fields[1][1] >= 32
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and number(fields[0]) in (0, 1):  # PKCS#8
        return algorithm(fields[1]) and fields[2][2] - fields[2][1] >= 16
    if tags[:2] == [INTEGER, OCTETS] and number(fields[0]) == 1:  # SEC 1
        return 16 <= fields[1][2] - fields[1][1] <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        return algorithm(fields[0]) and fields[1][2] - fields[1][1] >= 32
    return False


MAGIC = b"openssh-key-v1\0"
# Ciphers that append a tag of 16 bytes, which no length counts.
TAGGED = (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com")


def openssh_size(read: Callable[[int, int], bytes], size: int) -> int:
    """Bytes of the OpenSSH private key container that begins ``size`` bytes; 0 if its lengths don't add up.

    ``read`` gives bytes by position and number.
    """
    if size < len(MAGIC) or read(0, len(MAGIC)) != MAGIC:
        return 0
    at = len(MAGIC)

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(read(at - 4, 4), "big") if at <= size else size

    def string() -> int:
        """Length of the string at ``at``, which moves behind it."""
        nonlocal at
        n = number()
        at += n
        return n

    cipher = string()
    tag = 16 if at <= size and cipher <= 64 and read(at - cipher, cipher) in TAGGED else 0
    string(), string()
    keys = number()
    if at > size or not 1 <= keys <= 16:
        return 0
    for _ in range(keys):
        string()
    if not string() or at > size:
        return 0
    return min(at + tag, size)


def is_openssh_key(data: bytes) -> bool:
    """Whether bytes are one OpenSSH private key container with lengths that add up."""
    return 0 < openssh_size(lambda at, n: data[at : at + n], len(data)) == len(data)


def _decoded(body: str) -> bytes | None:
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def sequence_size(head: bytes) -> int:
    """Bytes of the ASN.1 sequence that begins with ``head``; 0 if none does."""
    if head[0] != SEQUENCE or head[1] < 0x80:
        return 2 + head[1] if head[0] == SEQUENCE else 0
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def _key_at(body: str, start: int) -> tuple[str, int] | None:
    """Kind of the key whose base64 begins at ``start``, and where it ends."""
    size = (len(body) - start) * 3 // 4
    if size < 6:
        return None

    def read(at: int, n: int) -> bytes:
        first = at // 3
        return _decoded(body[start + 4 * first : start - (at + n) // -3 * 4])[at - 3 * first :][:n]

    openssh = body.startswith("b3Bl", start)
    n = openssh_size(read, size) if openssh else sequence_size(read(0, 6))
    if not 0 < n <= size:
        return None
    end = start + (4 * n + 2) // 3
    data = _decoded(body[start:end])
    if data and (is_openssh_key(data) if openssh else is_private_key(data)):
        return "openssh" if openssh else "der", end
    return None


def _keys(text: str, start: int, end: int) -> Iterator[Span]:
    """Keys in a run of base64: at the start of each line that no key covers, and right behind each key."""
    lines = [m.span() for m in LINE.finditer(text, start, end)]
    body = "".join(text[a:b] for a, b in lines)
    # Where each line begins in the body.
    begins = [0, *accumulate(b - a for a, b in lines)]

    def place(at: int) -> int:
        line = bisect_right(begins, at) - 1
        return lines[line][0] + at - begins[line]

    done = 0
    for begin, after in zip(begins, begins[1:]):
        at = max(begin, done)
        while at < after and KEY_START.match(body[at : at + 4]):
            found = _key_at(body, at)
            if not found:
                break
            kind, done = found
            yield Span(kind, place(at), PADDING.match(text, place(done - 1) + 1).end())
            at = done


def confirmed_spans(text: str) -> Iterator[Span]:
    """Spans of the added kinds, each confirmed by its decoded content."""
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if is_signed_token(m[0]):
                yield Span("jwt", *m.span())
    at = 0
    while m := KEY_START.search(text, at):
        at = ENCODED.match(text, m.start()).end()
        yield from _keys(text, m.start(), at)
    for m in HEX_KEY.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            yield Span("der", *m.span())


def find(text: str) -> list[Span]:
    """All spans by start, then kind as in ``KINDS``; offsets are code points, ends exclusive."""
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add ``secrets``: array of (kind, start, end, secret) of the whole text.

    A null text counts as empty and has none.  Repeated rows each get their own result;
    empty tables give empty results; other columns pass through except the text itself,
    and an input column named ``secrets`` is replaced.
    """
    kept = [c for c in docs.columns if c not in (column, "secrets")]
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])
    )

    def run(batch: pa.RecordBatch):
        found = []
        for text in batch.column("__text"):
            text = text.as_py()
            found.append([{**s._asdict(), "secret": text[s.start : s.end]} for s in find(text)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], [*kept, "secrets"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    schema += "secrets array<struct<kind: string, start: bigint, end: bigint, secret: string>>"
    return map_batches(docs.select(*kept, text_or_empty(column).alias("__text")), run, schema)


def digests(column: str = "secrets") -> list[Column]:
    """Counts per base kind, a digest of the base spans, and all spans as text."""

    def of(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(column), lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(F.col(column), lambda s: s.kind.isin(*BASE))
    return [
        *map(count, BASE),
        F.sha2(of(base).cast("binary"), 256).alias("base_sha256"),
        of(F.col(column)).alias("spans"),
    ]


