import random
import re

from capsight.llm.components import connected_components
from capsight.llm.minhash import BLOCK, deduplicated, near_duplicates, rest_links
from tests.llm import frames


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    """doc_id -> (set size, least doc_id reachable), comparing all pairs."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i), d))) for i, (d, s) in enumerate(sets))


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = "changed" + str(rng.randrange(1000))
    return " ".join(w)


def test_matches_all_pairs(spark):
    rng = random.Random(5)
    rows = frames.awkward(rng)
    rows = [r for r in rows if len(r[1] or "") < 200_000] + [frames.row(12, "ONE")]
    base = [frames.prose(rng, 60) for _ in range(4)]
    for k in range(60):  # similarities on both sides of the threshold, in groups and chains
        rows.append(frames.row(100 + k, edited(rng, base[k % 4], k % 9)))
    found = near_duplicates(frames.documents(spark, rows), 2, 80).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute([(r[0], r[1]) for r in rows], 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert {r.doc_id: r.component_id for r in found}[12] == 4  # A-Z count as a-z


def test_five_words_is_the_default(spark):
    rng = random.Random(6)
    text = frames.prose(rng, 80)
    rows = [frames.row(1, text), frames.row(2, text + " end"), frames.row(3, edited(rng, text, 12))]
    found = {r.doc_id: r.component_id for r in near_duplicates(frames.documents(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    assert near_duplicates(frames.empty(spark), 2).collect() == []
    assert deduplicated(frames.empty(spark)).collect() == []


def test_rest_links_cover_blocks(spark):
    """Members of one large bucket, all but the hub's own component still apart, are compared across blocks."""
    rng = random.Random(7)
    n = BLOCK + 88
    texts = [frames.prose(rng, 40) for _ in range(n - 1)]
    texts.append(texts[0] + " tail")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    from capsight.llm.minhash import sign
    from capsight.llm.spark import written

    signed = written(sign(docs, 2), "test")
    classes = written(signed.select("set_id", F.col("doc_id").alias("some_doc"), "n_shingles", "bands", "sketch"), "test")
    members = signed.select(F.lit(1).cast("long").alias("bucket"), "set_id", F.lit(0).cast("long").alias("hub"))
    roots = spark.createDataFrame([], "node long, root long")
    found = rest_links(members, roots, docs, classes, 2, 80).collect()
    ids = {r.set_id: r.doc_id for r in signed.collect()}
    assert {frozenset((ids[r.a], ids[r.b])) for r in found} == {frozenset((0, n - 1))}


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    rng = random.Random(8)
    docs = frames.documents(spark, frames.awkward(rng))
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "10", "11", "None"])


def test_components_of_chain_star_and_nulls(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    extra = [(5, 5), (None, 3), (3, None), (101, 100), (7, 200)]
    edges = spark.createDataFrame(chain + star + extra, "a long, b long")
    found = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
    assert connected_components(edges.limit(0), "a", "b").collect() == []
