"""Vectorised word hashing over Arrow text columns, used inside ``mapInArrow`` tasks.

A word is a maximal run of bytes outside a separator set; with the default set that equals
``[^\\x20\\x09-\\x0D]+``. Letters A-Z count as a-z. Words get 64-bit hashes by a polynomial over
random byte values, so no Python object is made per word. Work goes in pieces of about
``PIECE`` bytes, cut between documents, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII other than letters and digits: for operators that look past punctuation.
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    values[65:91] = values[97:123]
    return values


_BYTE = _byte_values()
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of consecutive documents. ``bounds[i]:bounds[i+1]`` are those of document ``first + i``."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, offsets from 0, bytes) for runs of about PIECE bytes."""
    if not len(column):
        return
    at, data = _bytes_of(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, at[first : last + 1] - at[first], data[at[first] : at[last]]
        first = last


def words(column: pa.Array, separators: bytes = WHITE) -> Iterator[Words]:
    """The words of a text column, piece by piece."""
    is_separator = np.zeros(256, dtype=bool)
    is_separator[list(separators)] = True
    for first, _, at, data in pieces(column):
        n = len(data)
        inside = ~is_separator[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True  # a document's first byte, and one past its last
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power(_P, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power(_P_INVERSE, n + 1)[starts])
        yield Words(first, hashes, np.searchsorted(starts, at), starts, ends, data)


def plain_words(column: pa.Array) -> Iterator[Words]:
    """The words of a text column past punctuation and case: runs of letters, digits and non-ASCII signs, lower-cased."""
    return words(pc.utf8_lower(column), PUNCTUATION)


def hash_word(word: str) -> int:
    """The hash that ``words`` gives to this word."""
    (found,) = words(pa.array([word]), b"")
    return int(found.hashes[0])


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` neighbours; one per start, so ``width - 1`` fewer than words."""
    n = max(0, len(hashes) - width + 1)
    run = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        run = mix(run * _GOLD + hashes[k : k + n])
    return run


def shingle_sets(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document, sorted, with bounds.

    A document of fewer than ``width`` words has its whole sequence as its one shingle; one
    without words has none.
    """
    counts = np.diff(found.bounds)
    docs = found.doc_of_word()
    runs = chained(found.hashes, width)
    whole = np.arange(len(runs)) + width <= found.bounds[docs[: len(runs)] + 1]
    doc, value = docs[: len(runs)][whole], runs[whole]
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            run = np.zeros(len(short), dtype=np.uint64)
            for j in range(k):
                run = mix(run * _GOLD + found.hashes[found.bounds[short] + j])
            doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(run + np.uint64(k))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(found.n_docs + 1))
