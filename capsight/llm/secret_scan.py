"""Secret scan of texts: pattern spans, and spans confirmed by the structure of what they encode.

Patterns give the base spans (``assign``, ``access``, ``hex``). Beyond them a candidate is only
reported once it has been decoded and its structure holds: a PEM block whose body is a private
key in DER or OpenSSH form (``pem``), a three-part signed token with JSON header and claims
(``jwt``), and base64 or hex runs that decode to a key whose nested lengths add up (``der``).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Span kinds in order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der")

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: A body runs to the next sign that it cannot hold, so each one is read once; line ends may be written out.
_PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]++ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END \1-----", re.ASCII
)
#: Begins only where a run begins, and gives nothing back: each sign is read a bounded number of times.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
#: Signs of the shortest header that names an algorithm, ``{"alg":""}``, in base64.
_LEAST_HEADER = 14
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}+={0,2}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}+")
#: Texts without a match of this (in Arrow's linear-time matcher) have no span of any kind.
_MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|eyJ|-----BEGIN|[A-Za-z0-9+/]{40}|[0-9A-Fa-f]{64}"

_OPENSSH = b"openssh-key-v1\x00"
_INTEGER, _BIT_STRING, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``, or None if its length is malformed or too long."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if n == 0 or n > 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER values that fill ``at:end`` exactly, or None."""
    found = []
    while at < end:
        one = _header(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence that has the fields of a private or public key."""
    outer = _children(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    parts = _children(data, outer[0][1], outer[0][2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and set(tags[:9]) == {_INTEGER}:  # RSA: version, modulus, exponents, primes
        return True
    if tags[:2] == [_INTEGER, _OCTETS] and parts[0][2] - parts[0][1] == 1:  # elliptic curve, SEC 1
        return parts[1][2] - parts[1][1] >= 16
    inner = parts[1] if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] else None  # PKCS 8
    if inner is None and tags in ([_SEQUENCE, _OCTETS], [_SEQUENCE, _BIT_STRING]):  # encrypted PKCS 8, public key
        inner = parts[0]
    fields = _children(data, inner[1], inner[2]) if inner else None
    return bool(fields) and fields[0][0] == _OID


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic, then strings whose lengths add up."""
    if not data.startswith(_OPENSSH):
        return False
    at, strings = len(_OPENSSH), []
    for k in range(6):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4])
        if k == 3:  # the number of keys
            at += 4
            continue
        at += 4 + size
        if at > len(data):
            return False
        strings.append(size)
    return strings[0] > 0 and at == len(data)


def _decoded(run: str, alphabet: bytes | None = None) -> bytes | None:
    run = re.sub(r"\s|\\[nr]", "", run)
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), altchars=alphabet, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = _decoded(part, b"-_")
    if data is None:
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    """Whether three parts are a signed token: a header that names its algorithm, claims, a signature."""
    found = _json_object(header)
    if found is None or not isinstance(found.get("alg"), str):
        return False
    return _json_object(claims) is not None and _decoded(signature, b"-_") is not None


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the signed tokens, leftmost first. Each part of a dotted run is decoded a bounded number of times."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        starts = list(accumulate((len(p) + 1 for p in parts), initial=run.start()))
        k = 0
        while k + 2 < len(parts):
            at = parts[k].find("eyJ")
            if 0 <= at <= len(parts[k]) - _LEAST_HEADER and is_signed_token(parts[k][at:], parts[k + 1], parts[k + 2]):
                yield starts[k] + at, starts[k + 2] + len(parts[k + 2])
                k += 3
            else:
                k += 1


def _encoded(text: str) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, bytes) of the base64 and hex runs; of an odd number of hex digits, all but the last and all but the first."""
    for m in _BASE64.finditer(text):
        yield *m.span(), _decoded(m[0])
    for m in _ANY_HEX.finditer(text):
        for cut in range(1 + len(m[0]) % 2):
            lo, hi = m.start() + cut, m.end() - len(m[0]) % 2 + cut
            yield lo, hi, bytes.fromhex(text[lo:hi])


def _is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    found += [("pem", *m.span()) for m in _PEM.finditer(text) if _is_key(_decoded(m[2]))]
    found += [("jwt", *span) for span in _tokens(text)]
    taken = sorted((s, e) for kind, s, e in found if kind in ("pem", "jwt"))
    ends = [e for _, e in taken]
    free = lambda s, e: (k := bisect_right(ends, s)) == len(taken) or taken[k][0] >= e
    der = {(s, e) for s, e, data in _encoded(text) if _is_key(data) and free(s, e)}
    found += [("der", *span) for span in der]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = batch.column("text")
        maybe = pc.match_substring_regex(texts, _MAYBE).fill_null(False)
        spans = [[] for _ in range(batch.num_rows)]
        for i in maybe.to_numpy(zero_copy_only=False).nonzero()[0]:
            spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(texts[int(i)].as_py())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) of every row of ``docs`` (doc_id, text).

    Spans are code points, end exclusive, by start and then kind; spans of different kinds may
    overlap. Time is in proportion to a text's length, whatever it holds. A null or empty text has an empty array; equal rows give equal rows; a null doc_id
    stays null. Other columns are not read. One narrow pass without a shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
