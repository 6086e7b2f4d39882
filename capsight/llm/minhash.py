"""Near-duplicate groups of documents by MinHash.

1. ``sign``: each text's distinct word shingles, and the minima of ``N_HASHES`` universal hashes.
2. Texts with equal sets become one class; only classes take part from here on.
3. Banding: ``BANDS`` bands of ``ROWS`` minima give buckets. Of each bucket the member that shares
   buckets most becomes its hub, and every other member makes one candidate link to it, so a
   bucket of n classes gives n - 1 links, not all pairs.
4. Candidates are checked first on the signatures, then on the full shingle sets.
5. Components by alternating large-star and small-star.
6. A bucket that still holds more than one component is compared within itself, in blocks of
   bounded size, on signatures and then full sets; only confirmed links leave a block.

Step 6 makes the result that of comparing all members of each bucket: a hub saves comparisons
but never costs a link. Two classes of similarity 0.8 share no bucket with a chance of about
(1 - 0.8**4)**32 = 5e-8, and fail the signature check, if similar enough, with one of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.components import connected_components
from capsight.llm.spark import anti_by_size, semi_by_size, written
from capsight.llm.text import mix, shingle_sets, words

BANDS, ROWS = 32, 4
N_HASHES = BANDS * ROWS
#: A pair goes to the full check if this share of its minima agree, less than 4 standard deviations under 0.8.
MARGIN = 4 * (0.8 * 0.2 / N_HASHES) ** 0.5
#: Classes, and shingles, in one block of step 6.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of ``n`` multiply-add hashes modulo 2**64."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minima(sets: np.ndarray, bounds: np.ndarray, n: int = N_HASHES) -> np.ndarray:
    """Documents x hashes: the least value of each hash over each set. No set may be empty."""
    a, b = _universal(n)
    out = np.empty((n, len(bounds) - 1), dtype=np.uint64)
    buffer = np.empty(len(sets), dtype=np.uint64)
    for k in range(n):
        np.multiply(sets, a[k], out=buffer)
        np.add(buffer, b[k], out=buffer)
        out[k] = np.minimum.reduceat(buffer, bounds[:-1])
    return out.T


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column("text")):
                sets, bounds = shingle_sets(found, width)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                n = found.n_docs
                set_id = set_ids(sets, bounds)
                bands = np.zeros((n, BANDS), dtype=np.int64)
                sketch = np.zeros((n, N_HASHES), dtype=np.uint8)
                if len(full):
                    starts = np.append(bounds[:-1][full], len(sets))
                    low = minima(sets, starts)
                    sketch[full] = (mix(low) >> np.uint64(56)).astype(np.uint8)
                    for band in range(BANDS):
                        key = chained_rows(low[:, band * ROWS : (band + 1) * ROWS], band)
                        bands[full, band] = key.view(np.int64)
                ids = batch.column("doc_id").slice(found.first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(sizes.astype(np.int64)),
                        pa.array(set_id, mask=sizes == 0),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, bands.ravel()),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "bands", "sketch"],
                )

    return run


def chained_rows(low: np.ndarray, band: int) -> np.ndarray:
    """One bucket key per row of minima; the band's number is part of it."""
    key = np.full(len(low), band + 1, dtype=np.uint64)
    for column in low.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch) of every row; set_id is null for texts without words."""
    return docs.select("doc_id", "text").mapInArrow(
        _sign(width), "doc_id long, n_shingles long, set_id long, bands array<long>, sketch binary"
    )


def set_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, of its size and members; 0 for an empty one."""
    sizes = np.diff(bounds)
    ids = np.zeros(len(sizes), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        total = np.add.reduceat(mix(sets), bounds[:-1][full]) + sizes[full].astype(np.uint64)
        ids[full] = mix(total).view(np.int64)
    return ids


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column("text")):
                sets, bounds = shingle_sets(found, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(set_ids(sets, bounds), mask=np.diff(bounds) == 0),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), sets.view(np.int64)),
                    ],
                    names=["set_id", "shingles"],
                )

    return run


def _agreeing(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.floor((percent / 100 - MARGIN) * N_HASHES))
        for batch in batches:
            if batch.num_rows:
                a, b = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, N_HASHES)
                    for c in ("a_sketch", "b_sketch")
                )
                keep = pa.array((a == b).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    return run


def full_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of the given classes, from the text of one document each; written."""
    wanted = classes.join(ids, "set_id", "left_semi").select(F.col("some_doc").alias("doc_id"), "set_id")
    texts = semi_by_size(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id")
    sets = texts.mapInArrow(_shingles(width), "set_id long, shingles array<long>")
    return written(sets.where("set_id is not null").join(ids, "set_id", "left_semi").dropDuplicates(["set_id"]), "shingles")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids with 100 * intersection >= percent * union, on the full sets."""
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    sets = full_sets(ids, docs, classes, width)
    met = (
        pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
    )
    return met.where(
        F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("common"))
    ).select("a", "b")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of one key (the first ``n_keys`` columns) each, of batches in key order."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(keys[:, lo])
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), N_HASHES)


def _block_links(block: pa.Table, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components in one block that agree on signatures and then on full sets."""
    side = block.column("side").to_numpy()
    ids, roots = block.column("set_id").to_numpy(), block.column("root").to_numpy()
    sketches = _matrix(block.column("sketch"))
    sets = block.column("shingles").combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        sets = sets.chunk(0)
    at, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    sizes = np.diff(at)
    right = np.flatnonzero(side == 1)
    alone = not len(right)
    found_a, found_b = [], []
    for x in np.flatnonzero(side == 0):
        near = np.arange(x + 1, len(ids)) if alone else right
        near = near[roots[near] != roots[x]]
        near = near[(sketches[near] == sketches[x]).sum(axis=1) >= least]
        if len(near):
            own = values[at[x] : at[x + 1]]
            theirs = np.concatenate([values[at[y] : at[y + 1]] for y in near])
            where = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[where] == theirs).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            near = near[100 * common >= percent * (sizes[x] + sizes[near] - common)]
            found_a.append(np.full(len(near), ids[x]))
            found_b.append(ids[near])
    nothing = [np.empty(0, np.int64)]
    return np.concatenate(found_a or nothing), np.concatenate(found_b or nothing)


def _blocks(percent: int):
    least = int(np.floor((percent / 100 - MARGIN) * N_HASHES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, 3):
            a, b = _block_links(block, least, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def rest_links(members: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int):
    """Links between classes that share a bucket but no component yet, hub and member apart (those are done).

    A bucket's classes are dealt by hash into blocks of about BLOCK classes or BLOCK_SHINGLES
    shingles; each pair of blocks is one unit of work, so no task holds a large bucket whole.
    """
    placed = (
        members.where("set_id <> hub").join(roots, members["set_id"] == roots["node"], "left")
        .select("bucket", "set_id", F.coalesce("root", "set_id").alias("root"))
        .join(classes.select("set_id", "n_shingles"), "set_id")
    )
    mixed = (
        placed.groupBy("bucket")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
        .where("lo <> hi")
        .select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    rows = written(placed.join(mixed, "bucket").drop("n_shingles"), "mixed")
    sets = full_sets(rows.select("set_id").distinct(), docs, classes, width)
    dealt = (
        rows.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "set_id", "root",
        )
        .join(sets.join(classes.select("set_id", "sketch"), "set_id"), "set_id")
        .select("bucket", "i", "j", "side", "set_id", "root", "sketch", F.array_sort("shingles").alias("shingles"))
    )
    return (
        dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_blocks(percent), "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links of similarity ``percent`` / 100 or more,
    the document's own included; kept marks that document. n_links counts the confirmed links of
    the document's class to other classes. Texts that are null, empty or without words have no
    shingles and link with nothing; fewer words than ``width`` are one shingle. Equal sets are one
    class. Rows of equal doc_id and text are alike; a null doc_id is no candidate for component_id,
    and its row is kept only if its component has no doc_id. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    signed = written(sign(docs, width), "signed")
    classes = written(
        signed.where("set_id is not null").groupBy("set_id").agg(
            F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("some_doc"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    entries = classes.select("set_id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(entries.join(shared, "bucket"), "met")
    degree = met.groupBy("set_id").agg(F.sum("n").alias("degree"))
    ranked = met.select("bucket", "set_id").join(degree, "set_id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "set_id"))["set_id"].alias("hub"))
    members = written(met.select("bucket", "set_id").join(hubs, "bucket"), "members")
    star = members.where("set_id <> hub").select(
        F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")
    ).distinct()
    sketches = classes.select("set_id", "sketch")
    agreeing = (
        star.join(sketches.select(F.col("set_id").alias("a"), F.col("sketch").alias("a_sketch")), "a")
        .join(sketches.select(F.col("set_id").alias("b"), F.col("sketch").alias("b_sketch")), "b")
        .mapInArrow(_agreeing(percent), "a long, b long")
    )
    links = written(confirmed(written(agreeing, "pairs"), docs, classes, width, percent), "links")
    roots = connected_components(links, "a", "b")
    more = written(rest_links(members, roots, docs, classes, width, percent), "links")
    links = links.union(more)
    roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
    return _labelled(signed, classes, links, roots)


def _labelled(signed: DataFrame, classes: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per document from the components of the classes."""
    degree = (
        links.select(F.col("a").alias("set_id")).union(links.select("b")).groupBy("set_id")
        .agg(F.count("*").alias("links"))
    )
    placed = (
        classes.select("set_id", "first_doc").join(roots, classes["set_id"] == roots["node"], "left")
        .select("set_id", "first_doc", F.coalesce("root", "set_id").alias("root"))
    )
    least = placed.groupBy("root").agg(F.min("first_doc").alias("component"))
    by_class = placed.join(least, "root").join(degree, "set_id", "left").select("set_id", "component", "links")
    return (
        signed.select("doc_id", "n_shingles", "set_id").join(by_class, "set_id", "left")
        .select(
            "doc_id", "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of near-duplicates, all columns kept.

    The document of the least doc_id stays. Rows of one doc_id are one document: of repeated rows
    one stays, and a document goes if any row of it goes. Rows of null doc_id all stay.
    """
    found = written(near_duplicates(docs, width, percent).select("doc_id", "kept").where("doc_id is not null"), "kept")
    left = anti_by_size(docs, found.where("not kept").select("doc_id").distinct(), "doc_id")
    repeated = written(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left.select(docs.columns)
    once = semi_by_size(left, repeated, "doc_id").dropDuplicates(["doc_id"])
    return anti_by_size(left, repeated, "doc_id").select(docs.columns).union(once.select(docs.columns))
