import random
import re

from capsight.llm import decontam
from tests.llm import frames


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """(doc_id, item_id) with a segment, on some diagonal, that the rule accepts; and has a seed."""
    found = set()
    for d, text in docs:
        w = tokens(text)
        for i, asked in items:
            q = tokens(asked)
            for shift in range(-len(q), len(w)):
                equal = [(0 <= j + shift < len(w)) and w[j + shift] == q[j] for j in range(len(q))]
                seed = any(all(equal[s + k] for k, b in enumerate(m) if b == "1") for m in decontam.MASKS for s in range(len(q) - len(m) + 1) if 0 <= s + shift and s + shift + len(m) <= len(w))
                if not seed:
                    continue
                best, run, start = (0, 0), 0, 0
                for j, e in enumerate(equal):
                    if run <= 0:
                        run, start = 0, j
                    run += 1 if e else -decontam.MISMATCH
                    if run > best[0]:
                        best = (run, sum(equal[start : j + 1]))
                if best[1] >= min(decontam.MIN_EQUAL, -(-4 * len(q) // 5)):
                    found.add((d, i))
    return found


def test_matches_all_diagonals(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, frames.prose(rng, rng.choice([9, 14, 25, 40]))) for k in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = frames.awkward(rng)
    docs = [r for r in docs if len(r[1] or "") < 10_000]
    for k in range(60):
        w = items[k % 12][1].split()
        for j in rng.sample(range(len(w)), min(len(w), k % 7)):
            w[j] = "sub" + str(j)
        part = w[: len(w) - k % 3 * 5]
        docs.append(frames.row(1000 + k, frames.prose(rng, k % 20) + ", " + ", ".join(part).upper() + " " + frames.prose(rng, 8)))
    for k in range(30):
        docs.append(frames.row(2000 + k, frames.prose(rng, 60)))
    frame = frames.documents(spark, docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute([(r[0], r[1]) for r in docs], items)
    assert len(expected) > 25
    found = decontam.contaminated(frame, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    left = decontam.clean(frame, benchmark)
    assert left.columns == frame.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in docs if r[0] not in {d for d, _ in expected})
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 40)  # several blocks give the same
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, benchmark).collect()} == expected
    assert decontam.contaminated(frames.empty(spark), benchmark).collect() == []
    assert decontam.contaminated(frame, benchmark.limit(0)).collect() == []


def test_finds_all_items_of_four_fifths_without_asking_for_seeds(spark):
    rng = random.Random(12)
    sizes = [1, 2, 3, 5, 7, 8, 9, 10, 12, 15, 16, 20, 25, 40]
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate(sizes)]
    docs = []
    for k, (_, text) in enumerate(items):
        n = sizes[k]
        for t in range(12):
            w = text.split()
            for j in rng.sample(range(n), min(n, n // 5 + (t % 4 == 3))) if n >= 8 or t % 4 == 3 else []:
                w[j] = "sub"
            if t % 4 == 3 and n < 8:
                w[rng.randrange(n)] = "sub"
            docs.append(frames.row(100 * k + t, " ".join([frames.prose(rng, t), *w, frames.prose(rng, 3)])))
    expected = set()
    for d, text, *_ in docs:
        w = tokens(text)
        for i, asked in items:
            q = tokens(asked)
            most = max(sum(0 <= j + s < len(w) and w[j + s] == x for j, x in enumerate(q)) for s in range(-len(q), len(w)))
            if most >= (len(q) if len(q) < 8 else 0.8 * len(q)):
                expected.add((d, i))
    assert len(expected) >= 9 * len(items)
    frame, benchmark = frames.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, benchmark).collect()}
    assert expected <= found
    assert {(d, i) for d, i in found if sizes[i] < 15} == {(d, i) for d, i in expected if sizes[i] < 15}
    assert {r.doc_id for r in decontam.clean(frame, benchmark).collect()} == {r[0] for r in docs} - {d for d, _ in found}
