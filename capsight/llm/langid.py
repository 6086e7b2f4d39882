"""Language identification by nearest centroids of TF-IDF character n-gram vectors.

n-grams of 2 and 3 bytes of the lower-cased UTF-8 text, its other ASCII signs taken as spaces, are hashed to ``DIMENSION`` columns.
Document frequencies come from all learning rows (each task sends one count per column at most).
A bounded, documented sample of the learning rows gives each language ``CLUSTERS`` centroids by
spherical k-means. A text gets the language of the centroid with the highest cosine; if even
that is farther than the farthest ``REJECT`` share of the sample, it is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsight.llm.text import mix, pieces

DIMENSION = 4096
CLUSTERS = 4
#: Rows per language that centroids are fitted on.
SAMPLE = 1024
#: Learned languages; more distinct values than this are an error.
MAX_LANGUAGES = 256
REJECT = 0.001
ROUNDS = 12
_SLICE = 1 << 18

#: ASCII other than letters is a space; bytes of longer characters stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = 0x20
_LOWER[97:123] = np.arange(97, 123)


def _column_of_gram() -> tuple[np.ndarray, np.ndarray]:
    """Hash columns of all 2-byte values, and multipliers to combine them with a third byte."""
    two = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
    third = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))
    return two, third


_TWO, _THIRD = _column_of_gram()
_TWO_COLUMN = (_TWO % np.uint64(DIMENSION)).astype(np.int32)
_TWO_PART = (_TWO >> np.uint64(32)).astype(np.uint32)
_THIRD_PART = (_THIRD >> np.uint64(32)).astype(np.uint32)


def gram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x DIMENSION counts) of runs of a text column. Long texts are counted in slices."""
    for first, last, at, data in pieces(pc.utf8_lower(column)):
        data = _LOWER[data]
        for lo in range(first, last, 64):
            hi = min(lo + 64, last)
            out = np.zeros((hi - lo, DIMENSION), dtype=np.float32)
            for row in range(lo, hi):
                own = data[at[row - first] : at[row - first + 1]]
                space = own == 0x20
                own = own[np.append(~(space[1:] & space[:-1]), True)] if len(own) else own  # one space between words
                for start in range(0, max(len(own) - 1, 0), _SLICE):
                    part = own[start : start + _SLICE + 2].astype(np.uint16)
                    pair = (part[:-1] << 8) | part[1:]
                    triple = (_TWO_PART[pair[:-1]] ^ _THIRD_PART[part[2:]]) % np.uint32(DIMENSION)
                    pair = pair[:_SLICE]
                    out[row - lo] += np.bincount(_TWO_COLUMN[pair], minlength=DIMENSION)
                    out[row - lo] += np.bincount(triple[:_SLICE], minlength=DIMENSION)
            yield lo, out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMENSION, dtype=np.int64), 0
    for batch in batches:
        for _, counts in gram_counts(batch.column("text")):
            seen += (counts > 0).sum(axis=0)
            n += len(counts)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(DIMENSION), -1)), pa.array(np.append(seen, n))], names=["gram", "n"]
        )


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=vectors, where=norms > 0)


@dataclass
class Model:
    """Languages, the language and direction of each centroid, idf, and the least cosine not rejected."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reject_under: float

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.owner):
            return np.full(len(counts), -1), np.zeros(len(counts))
        cosine = _vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def _clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Directions of at most ``k`` clusters by spherical k-means from spread starting points."""
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    if not len(vectors):
        return vectors
    centers = vectors[:1]
    while len(centers) < min(k, len(vectors)):
        centers = np.vstack([centers, vectors[(vectors @ centers.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        nearest = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) for c in range(len(centers))])
        sums = sums[np.linalg.norm(sums, axis=1) > 0]
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centers


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, counts in gram_counts(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(lo, len(counts)), pa.array([c.tobytes() for c in counts], pa.binary())],
                names=["lang", "counts"],
            )


def _sampled(rows: DataFrame, counted: dict[str, int], sample: int, idf: np.ndarray) -> dict[str, np.ndarray]:
    """Vectors of about ``sample`` rows per language, 16 KB each whatever the text: those of the least hashes."""
    share = F.lit(0.0)
    for language, n in counted.items():
        share = F.when(F.col("lang") == language, min(1.0, sample / n)).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    found: dict[str, list[np.ndarray]] = {}
    for language, counts in picked.select("lang", "text").mapInArrow(_counts, "lang string, counts binary").collect():
        found.setdefault(language, []).append(np.frombuffer(counts, np.float32))
    return {language: _vectors(np.stack(counts), idf) for language, counts in found.items()}


def fit(docs: DataFrame, learning: Column, sample: int = SAMPLE) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) where ``learning`` holds and lang and text aren't null."""
    rows = docs.where(learning & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    frequency = rows.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = np.zeros(DIMENSION)
    n = 0
    for gram, count in frequency.collect():
        if gram < 0:
            n = count
        else:
            seen[gram] = count
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)
    counted = dict(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counted)
    owner, centroids, own = [], [], []
    vectors = _sampled(rows, counted, sample, idf)
    for number, language in enumerate(languages):
        mine = vectors.get(language, np.empty((0, DIMENSION), np.float32))
        found = _clustered(mine, CLUSTERS)
        owner += [number] * len(found)
        centroids.append(found)
        if len(found):
            own.append((mine @ found.T).max(axis=1))
    cosines = np.concatenate(own) if own else np.zeros(1)
    matrix = np.vstack(centroids) if centroids else np.empty((0, DIMENSION), np.float32)
    return Model(languages, np.array(owner, dtype=np.int64), matrix.astype(np.float32), idf, float(np.quantile(cosines, REJECT)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs`` (doc_id, text).

    score is the cosine to the nearest centroid, clipped to 0..1. A null text, or one without a
    letter, is ``und`` with score 0; so is every text if nothing was learned. rejected marks those
    and texts farther from all centroids than the model allows. Equal texts are alike; a null
    doc_id stays null; other columns are not read. The model is 4096 floats per centroid.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column("text")
            lettered = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            owner, score = np.full(len(texts), -1), np.zeros(len(texts))
            for lo, counts in gram_counts(texts):
                owner[lo : lo + len(counts)], score[lo : lo + len(counts)] = fitted.nearest(counts)
            known = lettered & (owner >= 0)
            score = np.where(known, score, 0.0)
            names = [fitted.languages[o] if k else "und" for o, k in zip(owner, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < fitted.reject_under))],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
