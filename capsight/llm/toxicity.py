"""Toxicity scores by a factorisation machine over hashed terms.

A text's terms are its distinct lower-cased words, punctuation apart, hashed to ``DIMENSION``
columns. The machine adds a weight per term and, for each pair of terms, the product of their
``FACTORS``-dimensional vectors, so a pair can weigh what neither term does alone. Terms of fewer
than ``MIN_TEXTS`` sampled texts have no column, nor have those that tell the classes apart no better
than chance, so long texts don't drown in noise: a term tells by itself (``MIN_CHI`` in the chi-square
statistic, or half of the number of texts in small samples), or in a pair with another, if texts with
both differ from all texts, and from those with either (``MIN_PAIR`` in the likelihood ratio, which is
higher because all pairs are tried).

It is fitted on the driver on a bounded, documented sample of labelled rows (``SAMPLE``, chosen by
hash): their terms are extracted by Spark, and at most ``MAX_TERMS`` pairs of row and column come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsight.llm.text import plain_words

DIMENSION = 1 << 18
FACTORS = 4
#: Labelled rows that the machine is fitted on, at most about so many.
SAMPLE = 12_000
MAX_TERMS = 20_000_000
MIN_TEXTS, MIN_CHI, MIN_PAIR = 4, 25.0, 40.0
EPOCHS, BATCH, RATE, PENALTY = 30, 256, 0.05, 1e-3


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, term columns, bounds) of runs of a text column; distinct within a row."""
    for found in plain_words(column):
        doc = found.doc_of_word()
        key = np.unique((doc.astype(np.int64) << 18) | (found.hashes >> np.uint64(46)).astype(np.int64))
        yield found.first, (key & (DIMENSION - 1)).astype(np.int32), np.searchsorted(key >> 18, np.arange(found.n_docs + 1))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, terms, bounds in _terms(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(first, len(bounds) - 1), pa.ListArray.from_arrays(bounds.astype(np.int32), terms)],
                names=["label", "terms"],
            )


@dataclass
class Machine:
    """Bias, and for each kept column its weight and vector. ``row_of`` maps a column to its row, or to -1."""

    bias: float
    row_of: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row = self.row_of[terms]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[row >= 0]
        row = row[row >= 0]
        return _probability(self.bias, self.weights, self.vectors, row, text, len(bounds) - 1)[0]


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place; floats also where there are none, unlike bincount's."""
    return np.bincount(at, values, n).astype(np.float64)


def _probability(bias, weights, vectors, row, text, n):
    """Probabilities, and the summed vectors that the gradient needs."""
    linear = _sums(text, weights[row], n)
    summed = np.stack([_sums(text, vectors[row, f], n) for f in range(vectors.shape[1])], axis=1)
    squared = np.stack([_sums(text, vectors[row, f] ** 2, n) for f in range(vectors.shape[1])], axis=1)
    z = bias + linear + 0.5 * (summed**2 - squared).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), summed


def _ratio(k: np.ndarray, m: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    """Likelihood ratio of k out of m against a rate."""
    rate = np.clip(rate, 1e-9, 1 - 1e-9)
    part = lambda x, share: x * np.log(np.maximum(x, 1e-300) / (m * share))
    return 2 * (part(k, rate) + part(m - k, 1 - rate))


def telling_in_pairs(labels: np.ndarray, terms: np.ndarray, bounds: np.ndarray, seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The columns of terms that tell the classes apart in a pair; each pair that occurs together is looked at."""
    n, share = len(labels), labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return np.empty(0, np.int64)
    # texts that the ratio needs even if all are of the rarer class
    least = max(MIN_TEXTS, int(np.ceil(MIN_PAIR / (-2 * np.log(min(share, 1 - share))))))
    columns = np.flatnonzero(seen >= least)
    columns = columns[np.argsort(seen[columns], kind="stable")]
    rank_of = np.full(len(seen), -1, dtype=np.int64)
    rank_of[columns] = np.arange(len(columns))
    text, rank = np.repeat(np.arange(n), np.diff(bounds)), rank_of[terms]
    text, rank = text[rank >= 0], rank[rank >= 0]
    order = np.lexsort((rank, text))
    text, rank = text[order], rank[order]
    ends = np.searchsorted(text, np.arange(n), side="right")[text]
    coded = rank * 2 + labels[text].astype(np.int64)
    by_rank = np.argsort(rank, kind="stable")
    edge = np.searchsorted(rank[by_rank], np.arange(len(columns) + 1))
    rates = toxic[columns] / np.maximum(seen[columns], 1)
    found = np.zeros(len(columns), dtype=bool)
    for r in range(len(columns)):
        # from the rarest on: each text's terms that are more frequent
        at = by_rank[edge[r] : edge[r + 1]]
        sizes = ends[at] - at - 1
        others = coded[np.repeat(at + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] - 2 * (r + 1)
        clean_toxic = np.bincount(others, minlength=2 * (len(columns) - r - 1)).reshape(-1, 2)
        m = clean_toxic.sum(axis=1)
        often = np.flatnonzero(m >= least)
        m, k, other = m[often], clean_toxic[often, 1], often + r + 1
        tells = np.minimum(np.minimum(_ratio(k, m, share), _ratio(k, m, rates[r])), _ratio(k, m, rates[other])) >= MIN_PAIR
        found[other[tells]] = True
        found[r] |= tells.any()
    return columns[found]


def train(labels: np.ndarray, terms: np.ndarray, bounds: np.ndarray) -> Machine:
    """Fits a machine by AdaGrad on rows of distinct terms."""
    n = len(labels)
    text = np.repeat(np.arange(n), np.diff(bounds))
    seen = np.bincount(terms, minlength=DIMENSION)
    toxic = np.bincount(terms, labels[text], DIMENSION)
    share = labels.mean() if n else 0.0
    expected = seen * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (toxic - expected) ** 2 / (expected * (1 - share) * (1 - seen / max(n, 1)))
    tells = np.nan_to_num(chi, posinf=np.inf) >= min(MIN_CHI, n / 2)
    tells[telling_in_pairs(labels, terms, bounds, seen, toxic)] = True
    kept = np.flatnonzero((seen >= MIN_TEXTS) & tells)
    row_of = np.full(DIMENSION, -1, dtype=np.int32)
    row_of[kept] = np.arange(len(kept))
    bias = float(np.log((share * n + 1) / ((1 - share) * n + 1)))
    rng = np.random.default_rng(11)
    weights, vectors = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))
    row = row_of[terms]
    text, row = text[row >= 0], row[row >= 0]
    edge = np.searchsorted(text, np.arange(n + 1))
    g_weights, g_vectors, g_bias = np.full(len(kept), 1e-6), np.full(vectors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS if len(kept) else 0):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            picked = order[start : start + BATCH]
            at = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in picked])
            own = np.repeat(np.arange(len(picked)), edge[picked + 1] - edge[picked])
            rows = row[at]
            p, summed = _probability(bias, weights, vectors, rows, own, len(picked))
            error = (p - labels[picked]) / len(picked)
            d_bias = error.sum()
            d_weights = _sums(rows, error[own], len(kept)) + PENALTY / n * weights
            pull = error[own, None] * (summed[own] - vectors[rows])
            d_vectors = np.stack([_sums(rows, pull[:, f], len(kept)) for f in range(FACTORS)], axis=1)
            d_vectors += PENALTY * vectors
            g_bias += d_bias**2
            g_weights += d_weights**2
            g_vectors += d_vectors**2
            bias -= RATE * 4 * d_bias / np.sqrt(g_bias)
            weights -= RATE * 4 * d_weights / np.sqrt(g_weights)
            vectors -= RATE * d_vectors / np.sqrt(g_vectors)
    return Machine(float(bias), row_of, weights, vectors)


def fit(docs: DataFrame, labels: DataFrame, learning: Column, sample: int = SAMPLE) -> Machine:
    """Learns ``labels`` (doc_id, toxic) of the documents for which ``learning`` (over doc_id) holds.

    Null ids and labels are left out; of several labels of one document the highest counts. With
    no labelled rows, or one class only, every text gets the share of toxic rows as its score.
    """
    known = labels.where(learning & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("label")
    )
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")
    found = rows.mapInArrow(_extract, "label int, terms array<int>").toArrow()
    own = [c.as_py() for c in found.column("label")]
    lists = found.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    terms = lists.values.to_numpy() if len(own) else np.empty(0, np.int32)
    bounds = lists.offsets.to_numpy() if len(own) else np.zeros(1, np.int64)
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} terms in the sample; lower it from {sample} rows")
    return train(np.array(own, dtype=np.float64), terms, bounds)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text); score is the probability of label 1.

    Null and empty texts score by the bias alone. Equal texts score alike; repeated rows give
    repeated rows; a null doc_id stays null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, terms, bounds in _terms(batch.column("text")):
                out[first : first + len(bounds) - 1] = shared.value.scores(terms, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for first, terms, bounds in _terms(batch.column("text")):
                keep[first : first + len(bounds) - 1] = shared.value.scores(terms, bounds) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
