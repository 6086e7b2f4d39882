import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsight.llm import language_model as lm
from capsight.llm.text import hash_word
from tests.llm import frames

END = "\n end"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(12)
    base = "the cat sat on the mat and the dog sat on the rug while a bird sang".split()
    texts = [" ".join(rng.choice(base) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    rows = [frames.row(1000 + i, t) for i, t in enumerate(texts)] + [r for r in frames.awkward(rng) if r[0] != 7]
    docs = frames.documents(spark, rows)
    learning = F.coalesce(F.col("doc_id") < 1200, F.lit(True))
    automaton, counts = lm.learn(docs, learning)
    return docs, rows, [r for r in rows if r[0] is None or r[0] < 1200], automaton, counts


def test_base_columns_match_brute_force(trained):
    docs, rows, learned, automaton, counts = trained
    c = Counter(w for r in learned for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    assert (automaton.n_tokens, automaton.n_distinct) == (n, v)
    expected = sorted((str(r[0]), len(t := tokens(r[1])), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 3)) for r in rows)
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 3)) for r in lm.score(docs, automaton, counts).collect())
    assert found == expected


def test_rare_tokens_join_to_the_same_scores(spark, trained, monkeypatch):
    docs, rows, _, automaton, counts = trained
    whole = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, automaton, counts).collect()}
    monkeypatch.setattr(lm, "WORDS", 8)
    small, all_counts = lm.learn(docs, F.coalesce(F.col("doc_id") < 1200, F.lit(True)), order=1)
    assert len(small.words) <= 8
    for r in lm.score(docs, small, all_counts).collect():
        assert r.n_known == whole[(r.doc_id, r.n_tokens)].n_known
        assert r.base_score == pytest.approx(whole[(r.doc_id, r.n_tokens)].base_score)
        assert r.score == pytest.approx(r.base_score)


def test_probabilities_of_a_context_sum_to_one(trained):
    """Over all known tokens and one unseen, from several states."""
    *_, automaton, _ = trained
    assert automaton.keys[2].size and automaton.keys[3].size
    unknown = 10 ** -automaton.log_total()
    for context in (["the"], ["sat", "on"], ["on", "the"], ["nowhere"]):
        start = np.array([hash_word(w) for w in context], dtype=np.uint64)
        total = sum(10 ** automaton.log_probabilities(np.append(start, w))[1][-1] for w in automaton.words)
        failing = automaton.log_probabilities(np.append(start, np.uint64(5)))[1][-1]
        assert total + unknown * 10**failing == pytest.approx(1, abs=1e-6)


def test_order_helps_on_held_out_text(trained):
    docs, _, _, automaton, counts = trained
    held = lm.score(docs.where("doc_id >= 1200"), automaton, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] < 0 and held[0] > held[1] * 1.2  # random words: at least not far worse


def test_empty_tables(spark):
    empty = frames.empty(spark)
    automaton, counts = lm.learn(empty, F.lit(True))
    assert lm.score(empty, automaton, counts).collect() == []
    docs = frames.documents(spark, [frames.row(1, "a b")])
    assert [tuple(r) for r in lm.score(docs, automaton, counts).collect()] == [(1, 3, 0, 0.0, 0.0)]


def brute_scores(learned, scored):
    """Backoff scores by dictionaries over all n-grams of LEAST or more."""
    padded = lambda text: [END, *tokens(text)]
    one = Counter(w for t in learned for w in tokens(t))
    counts = [Counter(tuple(s[i : i + n]) for t in learned for s in [padded(t)] for i in range(len(s) - n + 1)) for n in (2, 3)]
    kept = {g: c for found in counts for g, c in found.items() if c >= lm.LEAST}
    total = sum(one.values()) + len(one) + 1
    above = lambda h: one[h[0]] if len(h) == 1 else kept[h]
    arc = lambda g: (kept[g] - lm.DISCOUNT) / above(g[:-1])
    lower = lambda g: (one[g[1]] + 1) / total if len(g) == 2 else arc(g[1:])
    leaving = {}
    for g in kept:
        leaving.setdefault(g[:-1], []).append(g)
    back = {h: max(1 - sum(map(arc, gs)), 1e-12) / max(1 - sum(map(lower, gs)), 1e-12) for h, gs in leaving.items()}

    def p(w, h):
        if not h:
            return (one[w] + 1) / total
        return arc((*h, w)) if (*h, w) in kept else back.get(h, 1.0) * p(w, h[1:])

    return [sum(math.log10(p(s[i], tuple(s[max(0, i - 2) : i]))) for i in range(1, len(s))) for s in map(padded, scored)]


@pytest.mark.parametrize(("hot_words", "hot_grams", "bits"), [(1 << 18, 1 << 18, 28), (20, 12, 28), (20, 12, 10), (1, 0, 10)])
def test_all_ngrams_count_whatever_the_hot_part_holds(spark, monkeypatch, hot_words, hot_grams, bits):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[int(60 * rng.random() ** 2)] for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    monkeypatch.setattr(lm, "WORDS", hot_words)
    monkeypatch.setattr(lm, "GRAMS", hot_grams)
    monkeypatch.setattr(lm, "FILTER_BITS", bits)
    docs = frames.documents(spark, [frames.row(k, t) for k, t in enumerate(texts)])
    automaton, gains = lm.learn(docs, F.col("doc_id") < 120)
    found = {r.doc_id: r.score for r in lm.score(docs, automaton, gains).collect()}
    assert [found[k] for k in range(len(texts))] == pytest.approx(brute_scores(texts[:120], texts))


def test_only_what_is_read_stays_on_disk(spark, monkeypatch):
    from pathlib import Path

    from capsight.llm.spark import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    tables = lambda: {p for p in shared.glob("*-*") if any(p.glob("*.parquet"))}
    before, most, write = tables(), [], lm.written

    def counted(frame, name):
        found = write(frame, name)
        most.append(len(tables() - before))
        return found

    monkeypatch.setattr(lm, "written", counted)
    docs = frames.documents(spark, [frames.row(k, "a b c d a b c e a b") for k in range(20)])
    automaton, gains = lm.learn(docs, F.lit(True))
    assert {p.name.split("-")[0] for p in tables() - before} == {"gains", "states"} and max(most) <= 5
    learned = tables()
    lm.score(docs, automaton, gains)
    assert {p.name.split("-")[0] for p in tables() - learned} == {"scores"}


def test_ranges_of_keys_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(90 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    monkeypatch.setattr(lm, "RANGE", 400)
    monkeypatch.setattr(lm, "WORDS", 20)
    monkeypatch.setattr(lm, "GRAMS", 12)
    automaton, gains = lm.learn(docs := frames.documents(spark, [frames.row(k, t) for k, t in enumerate(texts)]), F.col("doc_id") < 50)
    held = [(r.k, r.part, len(r.key)) for r in gains.collect()]
    assert len({part for _, part, _ in held}) > 1 and len(held) == len({h[:2] for h in held})  # a row each
    found = {r.doc_id: r.score for r in lm.score(docs, automaton, gains).collect()}
    assert [found[k] for k in range(len(texts))] == pytest.approx(brute_scores(texts[:50], texts))
