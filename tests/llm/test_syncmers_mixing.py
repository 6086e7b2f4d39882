import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from capsight.llm import mixing, syncmers
from tests.llm import frames


def test_edited_texts_and_likeness(spark):
    rng = random.Random(14)
    rows = [r for r in frames.awkward(rng) if r[0] not in (9, None)]
    rows += [frames.row(1000 + 7 * k, frames.prose(rng, rng.randrange(1, 120)) + " é漢𝒳") for k in range(40)]
    rng.shuffle(rows)
    ordered = sorted((r[0], r[1] or "") for r in rows)
    found = syncmers.edited_fingerprints(frames.documents(spark, rows)).withColumn(
        "near", syncmers.likeness(F.col("hashes"), F.col("edited_hashes"))
    )
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[1][:n]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc].next_hashes == got[after[0]].hashes
        assert 0 <= got[doc].near <= 1
        if len(text) > 400 and " " in text:
            assert got[doc].near > 0.5
    assert got[8].hashes and got[1].hashes == []


def test_repeated_rows_null_ids_and_empty(spark):
    rows = frames.awkward(random.Random(1))
    found = syncmers.edited_fingerprints(frames.documents(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert syncmers.edited_fingerprints(frames.empty(spark)).collect() == []
    one = syncmers.edited_fingerprints(frames.documents(spark, [frames.row(1, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(15)
    passage = frames.prose(rng, 80)
    docs = frames.documents(spark, [frames.row(1, frames.prose(rng, 33) + " " + passage), frames.row(2, passage + " " + frames.prose(rng, 10))])
    found = syncmers.fingerprints(docs)
    matches = syncmers.positional_matches(found).collect()
    assert [(m.a, m.b, m.shift) for m in matches] == [(1, 2, -33)] and matches[0].n > 10


def test_anchors_are_closed_syncmers(spark):
    text = frames.prose(random.Random(16), 200)
    (row,) = syncmers.fingerprints(frames.documents(spark, [frames.row(1, text)])).collect()
    w = text.split()
    pairs = spark.createDataFrame(list(zip(range(len(w) - 1), w, w[1:], strict=False)), "i int, a string, b string")
    inner = [r.h for r in pairs.select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()]
    expected = [i for i in range(len(inner) - syncmers.INNER + 1) if min(inner[i : i + syncmers.INNER]) in (inner[i], inner[i + syncmers.INNER - 1])]
    assert [a["at"] for a in row.anchors] == expected


def test_every_text_with_words_has_an_anchor(spark):
    rng = random.Random(18)
    rows = [frames.row(100 * n + k, frames.prose(rng, n)) for n in range(1, 12) for k in range(60)]
    found = {r.doc_id: r.anchors for r in syncmers.fingerprints(frames.documents(spark, rows)).collect()}
    assert all(found.values())
    short = [tuple(a["hash"] for a in found[100 * n + k]) for n in (6, 7, 8) for k in range(60)]
    assert len(set(short)) == len(short)


def brute_targets(sizes):
    """The excess over each cap, shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: float(3 * sizes[s]) if s in capped else share * weight[s] for s in names}
        capped |= above


def test_mix_meets_targets(spark):
    rng = random.Random(17)
    rows = [r for r in frames.awkward(rng)]
    for k in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "d", "é"]) if k % 90 else "tiny"
        rows.append(frames.row(1000 + k, frames.prose(rng, int(rng.paretovariate(1.2) * 8)), source=source))
    docs = frames.documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        assert 0 <= r.copies <= 3
    expected = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6
    for source, target in expected.items():
        if sizes[source] and source is not None:
            largest = max(r["size"] for r in got if r.source == source)
            assert abs(taken[source] - target) <= largest, source
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.copies)
    assert sorted(map(key, again)) == sorted(map(key, got))
    out = mixing.emitted(mixing.mix(docs, carried=("text", "size")))
    assert out.count() == sum(r.copies for r in got)


def test_mix_empty(spark):
    assert mixing.mix(frames.empty(spark)).collect() == []
    assert [r.copies for r in mixing.mix(frames.documents(spark, [frames.row(1, None), frames.row(2, "")])).collect()] == [0, 0]
