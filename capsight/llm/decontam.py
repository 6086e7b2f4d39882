"""Benchmark decontamination by spaced-seed hashing.

Each mask of ``MASKS`` picks some token positions of a span and ignores the others, so a
substituted token spoils only the seeds that look at it. The seeds of the benchmark's items are a
hash table; a text's seeds are looked up in it, and each hit fixes an item and a diagonal. Along
that diagonal the overlap is verified: the segment of highest score (1 per equal token, -2 per
substituted one) must hold ``MIN_EQUAL`` equal tokens (or all but a fifth of a shorter item), or the
whole item must have four fifths of its tokens there, wherever the substituted ones stand. An item of
that share has ``RUN`` equal tokens in a row, so runs are seeds too, which only this second rule looks
at. Items shorter than ``SHORT`` tokens count where all of their tokens stand in a row.

The benchmark goes to the tasks in blocks of at most about ``BLOCK_TOKENS`` tokens, one broadcast
and one pass over the documents each, so memory is bounded for any benchmark. Documents are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.text import Words, mix, plain_words

#: 1 looks at the token, 0 ignores it.
MASKS = ("11010111", "1110010011", "1011001101")
MIN_EQUAL = 12
RUN, SHORT = 3, 8
MISMATCH = 2
BLOCK_TOKENS = 500_000
_BITS = 20

HIT_DDL = "item_id long, n_equal long, n_span long, first_word long, item_first_word long"


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each start where the mask fits."""
    n = max(0, len(hashes) - len(mask) + 1)
    key = np.full(n, int(mask, 2), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return key


@dataclass
class Index:
    """Seeds of benchmark items, sorted, with their item and place; the items' tokens; a bit per seed; the masks of them."""

    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    item_ids: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray
    bits: np.ndarray
    masks: tuple[str, ...]


def build(item_ids: list[int], texts: pa.Array) -> Index:
    """The index of the given items; those shorter than a run have the seed of their length, and without tokens none."""
    parts = list(plain_words(texts))
    tokens = np.concatenate([p.hashes for p in parts] or [np.empty(0, np.uint64)])
    sizes = np.concatenate([np.diff(p.bounds) for p in parts] or [np.empty(0, np.int64)])
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    masks = MASKS + tuple("1" * n for n in range(1, RUN + 1) if n == RUN or (sizes == n).any())
    keys, items, places = [], [], []
    for mask in masks:
        key = seeds(tokens, mask)
        start = np.arange(len(key))
        whole = start + len(mask) <= bounds[owner[start] + 1] if len(key) else np.zeros(0, bool)
        if len(key) and len(mask) < RUN:
            whole &= sizes[owner[start]] == len(mask)
        keys.append(key[whole])
        items.append(owner[start[whole]] if len(key) else np.empty(0, np.int64))
        places.append(start[whole])
    keys, items, places = np.concatenate(keys), np.concatenate(items).astype(np.int64), np.concatenate(places)
    order = np.argsort(keys, kind="stable")
    bits = np.zeros(1 << _BITS, dtype=bool)
    bits[keys >> np.uint64(64 - _BITS)] = True
    places = places - bounds[items] if len(items) else places
    return Index(keys[order], items[order], places[order], np.array(item_ids, dtype=np.int64), tokens, bounds, bits, masks)


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """(start, end) of the segment of highest score, the first of equal ones; empty if nothing is equal."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """Equal tokens that the whole of an item of n tokens needs."""
    return np.where(np.less(n, SHORT), n, -(-4 * n // 5))


def _mostly_equal(found: Words, index: Index, diagonals: np.ndarray) -> np.ndarray:
    """Whether each diagonal (document, item, shift) has the equal tokens that the whole item needs."""
    out = np.zeros(diagonals.shape[1], dtype=bool)
    sizes = np.diff(index.bounds)[diagonals[1]]
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):  # some million tokens at a time
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 21))))
        doc, item, shift = diagonals[:, start:stop]
        n = sizes[start:stop]
        which = np.repeat(np.arange(stop - start), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        word = found.bounds[doc[which]] + shift[which] + place
        inside = (place + shift[which] >= 0) & (word < found.bounds[doc[which] + 1])
        equal = np.zeros(len(which), dtype=bool)
        equal[inside] = found.hashes[word[inside]] == index.tokens[index.bounds[item[which[inside]]] + place[inside]]
        out[start:stop] = np.bincount(which, equal, stop - start) >= _least(n)
        start = stop
    return out


def hits(found: Words, index: Index) -> dict[int, dict[int, tuple[int, int, int, int]]]:
    """document -> item -> (equal tokens, length, first word, item's first word) of its best verified overlap."""
    docs = found.doc_of_word()
    seen = []
    for mask in index.masks:
        key = seeds(found.hashes, mask)
        start = np.flatnonzero(index.bits[key >> np.uint64(64 - _BITS)])
        start = start[start + len(mask) <= found.bounds[docs[start] + 1]] if len(start) else start
        lo = np.searchsorted(index.keys, key[start], side="left")
        n = np.searchsorted(index.keys, key[start], side="right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        word = np.repeat(start, n)
        diagonal = np.stack([docs[word], index.items[at], word - found.bounds[docs[word]] - index.places[at]])
        seen.append(diagonal if mask in MASKS else diagonal[:, _mostly_equal(found, index, diagonal)])
    out: dict[int, dict[int, tuple[int, int, int, int]]] = {}
    diagonals = np.unique(np.concatenate(seen, axis=1), axis=1) if seen else np.empty((3, 0), np.int64)
    for doc, item, shift in diagonals.T:
        own = found.hashes[found.bounds[doc] : found.bounds[doc + 1]]
        asked = index.tokens[index.bounds[item] : index.bounds[item + 1]]
        first, last = max(0, -shift), min(len(asked), len(own) - shift)
        equal = own[first + shift : last + shift] == asked[first:last]
        lo, hi = best_segment(equal)
        n_equal = int(equal[lo:hi].sum())
        least = _least(len(asked))
        if n_equal < min(MIN_EQUAL, least) and equal.sum() >= least:
            lo, hi = int(np.argmax(equal)), len(equal) - int(np.argmax(equal[::-1]))
            n_equal = int(equal.sum())
        if n_equal >= min(MIN_EQUAL, least):
            match = (n_equal, hi - lo, int(first + shift + lo), int(first + lo))
            best = out.setdefault(int(doc), {})
            key = int(index.item_ids[item])
            best[key] = max(best.get(key, match), match, key=lambda m: (m[0], -m[1], -m[2]))
    return out


def _indexes(benchmark: DataFrame) -> list[Index]:
    """One index per block of the benchmark (item_id, text); null ids and texts are left out."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * BLOCK_TOKENS)))
    out = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        text = part.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
        out.append(build(part.column("item_id").to_pylist(), text))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, n_span, first_word, item_first_word): one row per document row and item it contains.

    Words are runs of letters, digits and non-ASCII signs, lower-cased. n_equal of the n_span words
    from first_word on equal the item's from item_first_word on. Clean documents, null and empty
    texts have no rows; repeated rows and items of equal text each have their own; several overlaps
    with one item give the one with most equal words, then the shortest, then the first. A null
    doc_id stays null; other columns are not read.
    """

    def found_in(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for piece in plain_words(batch.column("text")):
                    rows = [
                        (ids[piece.first + doc].as_py(), item, *match)
                        for doc, best in hits(piece, shared.value).items() for item, match in best.items()
                    ]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                            names=["doc_id", "item_id", "n_equal", "n_span", "first_word", "item_first_word"],
                        )

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {HIT_DDL}")

    return reduce(DataFrame.union, [found_in(index) for index in _indexes(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    out = docs
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for piece in plain_words(batch.column("text")):
                    keep[[piece.first + doc for doc in hits(piece, shared.value)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
