"""Language-model scores from a weighted backoff automaton.

Counting covers the whole corpus: every learning text's tokens, then its pairs, then its triples,
each combined within the task and summed by key. An n-gram goes by the hash of its prefix's and its
suffix's; all of ``LEAST`` or more occurrences are kept, in written tables. Keys are shuffled by range,
as one row of arrays for each range and million keys, and meet in one task a range. Smoothed n-grams become
states: a state per kept n-gram, an arc per kept continuation with its discounted log-probability,
and a failure arc, with a backoff weight, to the state of the longest suffix.

The hot part of the automaton goes to the tasks (``WORDS``, ``GRAMS``: the most frequent tokens and
n-grams), and texts are walked through it once from left to right. What it lacks is not dropped: a
path's weight is a sum of one gain per n-gram in it, so each text's remaining distinct tokens and
n-grams meet the table of all gains by ranges of keys, and the score is that of the whole automaton.

Bitmaps of ``FILTER_BITS`` at most spare work: of the n-grams' parts while counting, of the table's
keys while scoring. When full they let more through, never less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsight.llm.spark import discard, shuffles_removed, written
from capsight.llm.text import Words, hash_word, mix, words

ORDER = 3
#: Of the hot part in the tasks: its tokens; its n-grams of each order above one.
WORDS, GRAMS = 1 << 18, 1 << 18
LEAST = 2
DISCOUNT = 0.6
#: Keys that a task holds before it passes them on.
HELD = 1 << 20
#: Keys of a range, at most about; a task holds those of one range.
RANGE = 1 << 21
#: Texts that a task holds the numbers of before it passes them on.
HELD_TEXTS = 1 << 15
#: The end token: no word holds white space.
END = np.uint64(hash_word("\n end"))
#: Texts are scored in so many parts, one after another: the keys that the tasks lack of one part are on disk at a time.
PARTS = 2
#: log2 of the bits of a bitmap over keys, at most.
FILTER_BITS = 28
#: A hot n-gram's number is (number of its prefix) * _BASE + (number of its last token).
_BASE = 1 << 32


def sequences(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with END after each document, and the bounds with those."""
    bounds = found.bounds + np.arange(len(found.bounds))
    tokens = np.empty(bounds[-1] - bounds[0], dtype=np.uint64)
    ends = bounds[1:] - 1
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[ends] = False
    tokens[is_word] = found.hashes
    tokens[ends] = END
    return tokens, bounds


def gram_keys(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return mix(prefix * np.uint64(0x9E3779B97F4A7C15) + suffix)


def ngrams(tokens: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, prefixes, suffixes, keys) of the n-grams that end at the places, for n from 2; END leads each text."""
    before = np.concatenate([np.array([END]), tokens[:-1]])[: len(tokens)]
    places, prefix, suffix = np.arange(len(tokens)), before, tokens
    for _ in range(2, order + 1):
        key = gram_keys(prefix, suffix)
        yield places, prefix, suffix, key
        # an n-gram's predecessor ends one place before, and END has no longer state
        follows = np.flatnonzero((places[1:] == places[:-1] + 1) & (before[places[1:]] != END)) + 1
        places, prefix, suffix = places[follows], key[follows - 1], key[follows]


def range_bits(n: int) -> int:
    """log2 of the number of ranges for ``n`` keys."""
    return (int(n) // RANGE).bit_length()


def range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The range of each key: its leading bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def by_range(keys: np.ndarray, bits: int, **columns: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(ranges, columns): for each range that the sorted keys have, the bytes of the columns' values there."""
    found = range_of(keys, bits)
    starts = firsts(found)
    ends = np.append(starts, len(keys))
    cut = {}
    for name, c in columns.items():
        data = pa.array(np.ascontiguousarray(c).view(np.uint8)).buffers()[1]
        cut[name] = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.array((ends * c.itemsize).astype(np.int32)).buffers()[1], data])
    return found[starts], cut


def values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a column of bytes one after another, and where each row's start and the last's end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    some = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return some.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _gathered(batches: Iterable[pa.RecordBatch], **kinds: type) -> dict[str, np.ndarray]:
    """The values of the named columns of all batches."""
    found: dict[str, list[np.ndarray]] = {name: [np.empty(0, kind)] for name, kind in kinds.items()}
    for batch in batches:
        for name, kind in kinds.items():
            found[name].append(values(batch.column(name), kind)[0])
    return {name: np.concatenate(some) for name, some in found.items()}


def _tallied(parts: Iterable[tuple[np.ndarray, ...]], names: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    """(part, names, n) rows of the counts of keys by range, combined for every HELD keys; a key's columns follow it, or are the key alone."""

    def tally(waiting: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, *columns = (np.concatenate(c) for c in zip(*waiting, strict=True))
        if columns:
            order = np.argsort(key)
            key = key[order]
            first = firsts(key)
            columns = [c[order[first]] for c in columns]
        else:
            key.sort()
            first = firsts(key)
            columns = [key[first]]
        n = np.diff(np.append(first, len(key))).astype(np.uint32)
        part, cut = by_range(key[first], bits, **dict(zip(names, columns, strict=True)), n=n)
        return pa.RecordBatch.from_pydict({"part": part, **cut})

    waiting: list[tuple[np.ndarray, ...]] = []
    size = 0
    for some in parts:
        waiting.append(some)
        size += len(some[0])
        if size >= HELD:
            yield tally(waiting)
            waiting, size = [], 0
    if size:
        yield tally(waiting)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct key, sum of its n), in order of key."""
    order = np.argsort(key)
    first = firsts(key[order])
    return order[first], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)


def _filter_bits(n: int) -> int:
    return min(FILTER_BITS, max(10, int(n).bit_length() + 3))


def _words_of(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row: places and values of a bitmap's words with the sorted keys' bits, at their leading bits."""
    place = keys >> np.uint64(64 - bits)
    first = firsts(place >> np.uint64(6))
    some = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
    at = (place[first] >> np.uint64(6)).astype(np.uint32)
    return pa.RecordBatch.from_pydict({"at": pa.array([at.tobytes()], pa.binary()), "bits": pa.array([some.tobytes()], pa.binary())})


def _add_words(out: np.ndarray, found: DataFrame) -> None:
    for batch in found.toArrow().to_batches():
        np.bitwise_or.at(out, values(batch.column("at"), np.uint32)[0], values(batch.column("bits"), np.uint64)[0])


def bitmap(frame: DataFrame, key: str, n: int) -> np.ndarray:
    """A bit for each of the ``n`` keys of a table whose files hold a range each, at their leading bits."""
    bits = _filter_bits(n)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.empty(0, np.uint64), *(batch.column(0).to_numpy().view(np.uint64) for batch in batches)])
        keys.sort()
        yield _words_of(keys, bits)

    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    _add_words(out, frame.select(key).mapInArrow(words_of, "at binary, bits binary"))
    return out


def may_hold(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a bitmap has the keys' bits."""
    place = keys >> np.uint64(64 - 6 - (len(found).bit_length() - 1))
    return (found[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


@dataclass
class Automaton:
    """The hot part. ``words``/``counts``: the frequent tokens, a token's number is its place there.

    ``keys[n]`` are the hot n-grams, each (number of its prefix) * _BASE + (number of its last token);
    ``arc[n]`` their log10 probabilities and ``back[n]`` the log10 weights of the failure arcs of the
    states of order n, both of the whole automaton. A hot n-gram's prefix and suffix are hot too.
    ``n_tokens`` and ``n_distinct`` are of the learning texts, ``filter`` is the bitmap of all keys.
    """

    words: np.ndarray
    counts: np.ndarray
    n_tokens: int
    n_distinct: int
    keys: dict[int, np.ndarray]
    arc: dict[int, np.ndarray]
    back: dict[int, np.ndarray]
    filter: np.ndarray
    order: int

    def states(self, tokens: np.ndarray, order: int) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
        """(place among words, per order the n-gram that ends at each token, and the state that it is for the next).

        -1 where there is none. A text starts in the state of END; END itself leaves no longer state.
        """
        at = _found(self.words, tokens)
        grams, after = {1: at}, {1: at}
        end = tokens == END
        for n in range(2, order + 1):
            before = np.empty(len(tokens), dtype=np.int64)
            before[1:] = after[n - 1][:-1]
            before[:1] = self.start() if n == 2 else -1
            possible = (before >= 0) & (at >= 0)
            gram = np.full(len(tokens), -1, dtype=np.int64)
            gram[possible] = _found(self.keys[n], before[possible] * _BASE + at[possible])
            grams[n] = gram
            after[n] = np.where(end, -1, gram)
        return at, grams, after

    def start(self) -> int:
        return int(_found(self.words, np.array([END]))[0])

    def log_probabilities(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among words, log10 probability) of each token by the hot part; of absent ones, only the failure weights on the way down."""
        return self.walked(tokens)[:2]

    def walked(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(place among words, log10 probability, per order the hot n-gram or -1) of each token."""
        order = max(self.keys, default=1)
        at, grams, after = self.states(tokens, order)
        out = np.where(at >= 0, self.log_counts(at) - self.log_total(), 0.0)
        for n in range(2, order + 1):
            before = np.empty(len(tokens), dtype=np.int64)
            before[1:] = after[n - 1][:-1]
            before[:1] = self.start() if n == 2 else -1
            there = before >= 0
            failing = there & (grams[n] < 0)
            out[failing] += self.back[n - 1][before[failing]]
            arcs = grams[n] >= 0
            out[arcs] = self.arc[n][grams[n][arcs]]
        return at, out, grams

    def log_counts(self, at: np.ndarray) -> np.ndarray:
        """log10(count + 1) at places among words, 0 for -1."""
        if not len(self.counts):
            return np.zeros(len(at))
        return np.where(at >= 0, np.log10(self.counts[at] + 1.0), 0.0)

    def log_total(self) -> float:
        return float(np.log10(self.n_tokens + self.n_distinct + 1.0))


def _threshold(counts: DataFrame, most: int, least: int) -> int | None:
    """The lowest threshold of ``n`` that at most ``most`` rows reach; None if there is none.

    Thresholds are counts of six leading bits, so the histogram behind them has few rows.
    """
    low = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 6, 0)), greatest(length(bin(n)) - 6, 0))")
    histogram = sorted(counts.groupBy("n").agg(F.count("*").alias("rows")).groupBy(low.alias("low")).agg(F.sum("rows")).collect(), reverse=True)
    total, threshold = 0, None
    for low, rows in histogram:
        total += rows
        if total > most or low < least:
            break
        threshold = low
    return threshold


def _frequent(counts: DataFrame, threshold: int | None) -> DataFrame:
    return counts.where(F.lit(False) if threshold is None else F.col("n") >= threshold)


def _numbers(frame: DataFrame, *names: str) -> list[np.ndarray]:
    found = frame.select(*names).toArrow()
    return [found.column(c).to_numpy().astype(np.int64) for c in names]


def _token_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for found in words(batch.column("text")):
            yield (sequences(found)[0],)


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: c.view(np.int64) for name, c in columns.items()})


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n): the counts of all tokens of the texts, END among them."""
    # a token takes two bytes at least, and mostly more; many are combined before
    bits = range_bits(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 8)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches, token=np.uint64, n=np.uint32)
        at, n = _summed(found["token"], found["n"])
        yield _longs(token=found["token"][at], n=n)

    counted = texts.select("text").mapInArrow(lambda b: _tallied(_token_keys(b), ["token"], bits), "part int, token binary, n binary")
    return counted.repartitionById(1 << bits, F.col("part")).mapInArrow(summed, "token long, n long")


def count_grams(texts: DataFrame, n: int, parts: np.ndarray, tokens: int) -> DataFrame:
    """(prefix, suffix, key, n) of all n-grams of LEAST or more; ``parts`` is a bitmap of the kept ones of the order below, ``tokens`` the number of all."""
    shared = texts.sparkSession.sparkContext.broadcast(parts)
    bits = range_bits(tokens)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for found in words(batch.column("text")):
                *_, (_, prefix, suffix, key) = ngrams(sequences(found)[0], n)
                # rarer parts than LEAST make no n-gram of LEAST
                kept = np.flatnonzero(may_hold(shared.value, prefix))
                kept = kept[may_hold(shared.value, suffix[kept])]
                yield key[kept], prefix[kept], suffix[kept]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches, prefix=np.uint64, suffix=np.uint64, n=np.uint32)
        key = gram_keys(found["prefix"], found["suffix"])
        at, total = _summed(key, found["n"])
        at, total = at[total >= LEAST], total[total >= LEAST]
        yield _longs(prefix=found["prefix"][at], suffix=found["suffix"][at], key=key[at], n=total)

    counted = texts.mapInArrow(lambda b: _tallied(keys(b), ["prefix", "suffix"], bits), "part int, prefix binary, suffix binary, n binary")
    kept = counted.repartitionById(1 << bits, F.col("part")).mapInArrow(summed, "prefix long, suffix long, key long, n long")
    return written(kept, "grams")


def gain_blocks(frame: DataFrame, k: int, bits: int, name: str) -> DataFrame:
    """(k, part, key, n, gain): the table ``frame`` (key, n, gain) as a row of sorted keys for each range, written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            key, n, gain = (np.concatenate(c) for c in zip(*waiting, strict=True))
            order = np.argsort(key)
            part, found = by_range(key[order], bits, key=key[order], gain=gain[order], **({"n": n[order]} if k == 1 else {}))
            found.setdefault("n", pa.array([b""] * len(part), pa.binary()))
            return pa.RecordBatch.from_pydict({"part": part, "key": found["key"], "n": found["n"], "gain": found["gain"]})

        for batch in batches:
            waiting.append([batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy(), batch.column("gain").to_numpy()])
            size += batch.num_rows
            if size >= HELD:
                yield block()
                waiting, size = [], 0
        if size:
            yield block()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches, key=np.uint64, n=np.int64, gain=np.float64)
        order = np.argsort(found["key"])
        if len(order):
            part, one = by_range(found["key"][order], bits, **{c: v[order] for c, v in found.items() if len(v)})
            one.setdefault("n", pa.array([b""] * len(part), pa.binary()))
            yield pa.RecordBatch.from_pydict({"k": np.full(len(part), k, np.int32), "part": part, "key": one["key"], "n": one["n"], "gain": one["gain"]})

    blocks = frame.select("key", "n", "gain").mapInArrow(cut, "part int, key binary, n binary, gain binary")
    return written(blocks.repartitionById(1 << bits, F.col("part")).mapInArrow(merged, "k int, part int, key binary, n binary, gain binary"), name)


def block_bitmap(tables: list[DataFrame], n: int) -> np.ndarray:
    """``bitmap`` of the ``n`` keys of tables of ``gain_blocks``."""
    bits = _filter_bits(n)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _words_of(values(batch.column("key").slice(row, 1), np.uint64)[0], bits)

    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for blocks in tables:
        _add_words(out, blocks.select("key").mapInArrow(words_of, "at binary, bits binary"))
    return out


def learn(docs: DataFrame, learning: Column, order: int = ORDER) -> tuple[Automaton, DataFrame]:
    """The automaton's hot part, and the table (k, part, key, n, gain) of all of it, of the rows of ``docs`` where ``learning`` holds.

    A row has all k-grams of a range of keys, see ``gain_blocks``. Keys are tokens and n-grams; n is empty but for tokens. A token's gain is log10(n + 1) and its
    failure weight; an n-gram's is its arc less the way to the same token over its prefix's failure
    arc, and its own failure weight: along a text they add up to the arcs and failures taken.

    Each join is written and what it has read is deleted, so few tables are on disk at a time.
    """
    with shuffles_removed(docs.sparkSession):
        return _learned(docs.where(learning).select("text"), order)


def _learned(texts: DataFrame, order: int) -> tuple[Automaton, DataFrame]:
    counts = written(count_tokens(texts), "tokens")
    n_tokens, n_distinct, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") >= LEAST)).first()
    log_total = float(np.log10(n_tokens + n_distinct + 1.0))
    # a state's gain lacks the failure weight of its own, which the order above tells
    states = counts.select(
        F.col("token").alias("key"), "n", (F.log10(F.col("n") + 1.0) - log_total).alias("arc"), F.log10(F.col("n") + 1.0).alias("gain")
    )
    kept, stored = bitmap(states.where(F.col("n") >= LEAST), "key", size) if order > 1 else None, counts
    end = F.col("key") == int(END.view(np.int64))
    bits, total = range_bits(n_tokens), int(n_distinct)
    least = _threshold(states, WORDS - 1, 1)
    parts: dict[int, list[np.ndarray]] = {}  # of the hot n-grams: prefixes, suffixes, keys
    hot: dict[int, list[np.ndarray]] = {}  # of the hot states: keys, counts, arcs, failure weights
    gains: list[DataFrame] = []
    for k in range(2, order + 1):
        grams = count_grams(texts, k, kept, n_tokens)
        size = grams.count()
        kept = bitmap(grams, "key", size) if k < order else None
        total += size
        enough, rare = states.where(F.col("n") >= LEAST), states.where(F.col("n") < LEAST)  # only these have continuations; rare tokens
        above = _threshold(grams, GRAMS, LEAST)
        parts[k] = _columns(_frequent(grams, above), "prefix", "suffix", "key")
        lowered = written(
            grams.join(enough.select(F.col("key").alias("suffix"), F.col("arc").alias("lower")), "suffix").select("prefix", "key", "n", "lower"),
            "lowered",
        )
        discard(grams)
        left = lambda c: F.greatest(1 - c, F.lit(1e-12))
        leaving = lowered.groupBy(F.col("prefix").alias("key")).agg(
            (F.sum("n") - F.count("*") * DISCOUNT).alias("taken"), F.sum(F.pow(F.lit(10.0), "lower")).alias("lower")
        )
        back = F.log10(left(F.col("taken") / F.col("n")) / left(F.col("lower")))
        ended = written(enough.select("key", "n", "gain").join(leaving, "key", "left").select("key", "n", "gain", back.alias("back")), "backs")
        backs = ended.where(F.col("back").isNotNull()).select("key", F.col("n").alias("above"), "back")
        arc = F.log10((F.col("n") - DISCOUNT) / F.col("above"))
        found = written(
            lowered.join(backs.withColumnRenamed("key", "prefix"), "prefix")
            .select("key", "n", arc.alias("arc"), (arc - F.col("lower") - F.col("back")).alias("gain")),
            "states" if k < order else "arcs",
        )
        discard(lowered)
        hot[k - 1] = _hot(states, least, backs, k - 1, end)
        whole = ended.select("key", "n", (F.col("gain") + F.coalesce("back", F.lit(0.0))).alias("gain"))
        gains.append(gain_blocks(whole.union(rare.select("key", "n", "gain")) if k == 2 else whole, k - 1, bits, "gains"))
        discard(stored, ended)
        states, stored, least = found, found, above
    hot[order] = _hot(states, least, None, order, end)
    gains.append(gain_blocks(states, order, bits, "states"))
    discard(stored)
    table = reduce(DataFrame.union, gains)

    key, n, _, back = hot[1]
    tokens = key.view(np.uint64)
    by_hash = np.argsort(tokens)
    tokens, n = tokens[by_hash], n[by_hash]
    automaton = Automaton(
        tokens, n, int(n_tokens), int(n_distinct), {}, {}, {1: back[by_hash]}, block_bitmap(gains, total), order
    )
    hashed, last = tokens, np.arange(len(tokens))  # of the order below: keys, and numbers of last tokens
    by_hash = np.arange(len(tokens))
    for k in range(2, order + 1):
        prefix, suffix, key = (c[np.argsort(parts[k][2])] for c in parts[k])
        arc, back = (c[np.argsort(hot[k][0])] for c in hot[k][2:])
        at = [_found(hashed, c.view(np.uint64)) for c in (prefix, suffix)]
        both = (at[0] >= 0) & (at[1] >= 0)
        number = by_hash[at[0][both]] * _BASE + last[by_hash[at[1][both]]]
        ranked = np.argsort(number)
        automaton.keys[k], automaton.arc[k], automaton.back[k] = number[ranked], arc[both][ranked], back[both][ranked]
        key = key.view(np.uint64)[both][ranked]
        by_hash = np.argsort(key)
        hashed, last = key[by_hash], automaton.keys[k] % _BASE
    return automaton, table


def _hot(states: DataFrame, least: int | None, backs: DataFrame | None, k: int, end: Column) -> list[np.ndarray]:
    """(keys, counts, arcs, failure weights) of the states of order k from a count on; END is among the tokens."""
    rows = _frequent(states, least)
    rows = rows.union(states.where(end)).distinct() if k == 1 else rows
    key, n, arc = _columns(rows, "key", "n", "arc")
    back = np.zeros(len(key))
    if backs is not None and len(key):
        found, weight = _columns(backs.join(F.broadcast(rows.select("key")), "key", "left_semi"), "key", "back")
        by_key = np.argsort(key)
        back[by_key[np.searchsorted(key[by_key], found)]] = weight
    return [key, n, arc, back]


def _columns(frame: DataFrame, *names: str) -> list[np.ndarray]:
    found = frame.select(*names).toArrow()
    return [found.column(c).to_numpy().copy() for c in names]


_RESTS = "k int, part int, key binary, n binary, gain binary, block long, doc binary, head binary"
_HEAD = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_here", pa.int64()), ("log_c", pa.float64()), ("log_p", pa.float64())])


def _traverse(shared, bits: int):
    """Blocks of texts, as rows of _RESTS: what the hot part tells of each text in ``head``, and by order and range what it lacks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        block: int | None = None
        heads: list[pa.RecordBatch] = []
        rests: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = docs = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            head = pa.Table.from_batches(heads, _HEAD).combine_chunks().to_batches()[0].serialize().to_pybytes()
            yield _rows(0, _home(block, bits), block, head=pa.array([head], pa.binary()))
            for k, some in rests.items():
                key, doc = (np.concatenate(c) for c in zip(*some, strict=True))
                order = np.argsort(key)
                part, cut = by_range(key[order], bits, key=key[order], doc=doc[order])
                yield _rows(k, part, block, **cut)

        for batch in batches:
            for found in words(batch.column("text")):
                tokens, bounds = sequences(found)
                doc = np.repeat(np.arange(found.n_docs, dtype=np.int32), np.diff(bounds))
                at, log_p, grams = automaton.walked(tokens)
                here = at >= 0
                log_c = automaton.log_counts(at)
                part = batch.slice(found.first, found.n_docs)
                if block is None:
                    block = part.column("row")[0].as_py()
                for k, (places, _, _, key) in enumerate([(np.arange(len(tokens)), None, None, tokens), *ngrams(tokens, automaton.order)], 1):
                    cold = np.flatnonzero(grams[k][places] < 0 if k in grams else np.ones(len(places), dtype=bool))
                    cold = cold[may_hold(automaton.filter, key[cold])]
                    rests.setdefault(k, []).append((key[cold], doc[places[cold]] + np.int32(docs)))
                    size += len(cold)
                heads.append(
                    pa.RecordBatch.from_arrays(
                        [
                            # a copy: a slice would keep the texts
                            part.column("doc_id").take(pa.array(np.arange(found.n_docs))), pa.array(np.diff(bounds)),
                            pa.array(np.bincount(doc, here, found.n_docs).astype(np.int64)),
                            pa.array(np.bincount(doc, log_c, found.n_docs)), pa.array(np.bincount(doc, log_p, found.n_docs)),
                        ],
                        schema=_HEAD,
                    )
                )
                docs += found.n_docs
                if size >= HELD or docs >= HELD_TEXTS:
                    yield from passed_on()
                    block, heads, rests, size, docs = None, [], {}, 0, 0
        if heads:
            yield from passed_on()

    return run


def _home(block: int, bits: int) -> np.ndarray:
    """The range that a block's texts are put together in."""
    return range_of(mix(np.array([block], np.int64).view(np.uint64) + np.uint64(1)), bits)


def _rows(k: int, part: np.ndarray, block: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of _RESTS, those of a block."""
    found = {"k": np.full(len(part), k, np.int32), "part": part, "block": np.full(len(part), block, np.int64), **columns}
    names = [f.split()[0] for f in _RESTS.split(", ")]
    return pa.RecordBatch.from_pydict({c: found.get(c, pa.nulls(len(part), pa.binary())) for c in names})


def _looked_up(bits: int):
    """Of a range: blocks' keys that the table of gains has, as (part, block, doc, gain, known, log, head); heads go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.nulls(1, pa.binary())
        tables: dict[int, list[np.ndarray]] = {}
        rests: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def row(block: int, **columns) -> pa.RecordBatch:
            some = {c: pa.array([columns[c]], pa.binary()) if c in columns else empty for c in ("doc", "gain", "known", "log", "head")}
            return pa.RecordBatch.from_pydict({"part": _home(block, bits), "block": np.array([block]), **some})

        for batch in batches:
            blocks, heads = batch.column("block").to_pylist(), batch.column("head")
            for i, (k, block) in enumerate(zip(batch.column("k").to_pylist(), blocks, strict=True)):
                if heads[i].is_valid:
                    yield row(block, head=heads[i].as_py())
                    continue
                of = lambda name, kind: values(batch.column(name).slice(i, 1), kind)[0]  # noqa: B023, E731
                if block is None:
                    tables[k] = [of("key", np.uint64), of("n", np.int64), of("gain", np.float64)]
                else:
                    rests.append((k, block, of("key", np.uint64), of("doc", np.int32)))
        for k, block, key, doc in rests:
            if k not in tables:
                continue
            keys, n, gain = tables[k]
            at = _found(keys, key)
            there = np.flatnonzero(at >= 0)
            if len(there):
                at, columns = at[there], {"doc": doc[there]}
                columns["gain"] = gain[at]
                if k == 1:
                    columns |= {"known": doc[there], "log": np.log10(n[at] + 1.0)}
                yield row(block, **{c: v.tobytes() for c, v in columns.items()})

    return run


def _put_together(total: float):
    """The scores of the texts of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, pa.RecordBatch] = {}
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if (head := batch.column("head")[i]).is_valid:
                    heads[block] = pa.ipc.read_record_batch(pa.py_buffer(head.as_py()), _HEAD)
                else:
                    of = lambda name, kind: values(batch.column(name).slice(i, 1), kind)[0]  # noqa: B023, E731
                    some = of("doc", np.int32), of("gain", np.float64), of("known", np.int32), of("log", np.float64)
                    found.setdefault(block, []).append(some)
        for block, head in heads.items():
            n_tokens, n_here, log_c, log_p = (head.column(c).to_numpy() for c in _HEAD.names[1:])
            none = np.empty(0, np.int32), np.empty(0)
            doc, gain, known, log = (np.concatenate(c) for c in zip(none * 2, *found.get(block, []), strict=True))
            size = head.num_rows
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": head.column("doc_id"), "n_tokens": n_tokens, "n_known": n_here + np.bincount(known, minlength=size),
                    "base_score": log_c + np.bincount(known, log, size) - n_tokens * total,
                    "score": log_p + np.bincount(doc, gain, size) - (n_tokens - n_here) * total,
                }
            )

    return run


def score(docs: DataFrame, automaton: Automaton, gains: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text).

    Tokens are words with A-Z as a-z, then one end. base_score is the log10 probability under
    add-one smoothed token counts, score that of the automaton. Null and empty texts are the end
    alone; without learning texts every token has probability 1. Repeated rows are scored each; a
    null doc_id stays null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS))
    with shuffles_removed(docs.sparkSession):
        scored = [_scored(docs.where(part == k), shared, automaton, gains) for k in range(PARTS)]
    return reduce(DataFrame.union, scored)


def _scored(docs: DataFrame, shared, automaton: Automaton, gains: DataFrame) -> DataFrame:
    """The scores of some of the rows, written; what the tasks lack of their texts is on disk until then."""
    bits = range_bits(automaton.n_tokens)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    lacking = rows.mapInArrow(_traverse(shared, bits), _RESTS).unionByName(gains, allowMissingColumns=True)
    found = lacking.repartitionById(1 << bits, F.col("part")).mapInArrow(
        _looked_up(bits), "part int, block long, doc binary, gain binary, known binary, log binary, head binary"
    )
    scores = found.repartitionById(1 << bits, F.col("part")).mapInArrow(
        _put_together(automaton.log_total()), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return written(scores, "scores")
