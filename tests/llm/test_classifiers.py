"""Toxicity and language identification: held-out accuracy and awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from capsight.llm import langid, toxicity
from capsight.llm.spark import fold
from tests.llm import frames


def test_machine_learns_a_pair_that_neither_term_shows():
    rng = np.random.default_rng(4)
    n = 3000
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    labels = (a ^ b).astype(float)  # the linear part alone is at chance
    keep_chi, toxicity.MIN_CHI = toxicity.MIN_CHI, 0.0
    try:
        rows = [[1 + int(x), 3 + int(y)] for x, y in zip(a, b, strict=True)]
        terms = np.array(sum(rows, []), dtype=np.int32)
        machine = toxicity.train(labels, terms, np.arange(n + 1) * 2)
    finally:
        toxicity.MIN_CHI = keep_chi
    right = (machine.scores(terms, np.arange(n + 1) * 2) >= 0.5) == (labels > 0)
    assert right.mean() > 0.95


def test_pair_is_learned_among_other_terms_with_the_fixed_values():
    rng = np.random.default_rng(4)
    n = 4000
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    labels = (a ^ b).astype(float)
    rows = [np.unique(np.append([1 + int(x), 3 + int(y)], 10 + (5000 * rng.random(100) ** 2).astype(int))) for x, y in zip(a, b, strict=True)]
    bounds = lambda part: np.cumsum([0, *map(len, part)])
    machine = toxicity.train(labels[:3000], np.concatenate(rows[:3000]).astype(np.int32), bounds(rows[:3000]))
    assert set(np.flatnonzero(machine.row_of >= 0)) >= {1, 2, 3, 4}
    right = (machine.scores(np.concatenate(rows[3000:]), bounds(rows[3000:])) >= 0.5) == (labels[3000:] > 0)
    assert right.mean() > 0.95


def test_few_labelled_rows_keep_a_telling_term():
    labels = np.array([1.0] * 8 + [0.0] * 12)
    terms = np.array([1] * 8 + [2] * 12, dtype=np.int32)
    machine = toxicity.train(labels, terms, np.arange(21))
    assert (machine.scores(terms, np.arange(21)) >= 0.5).tolist() == (labels > 0).tolist()


def test_toxicity_held_out_and_awkward(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        text = frames.prose(rng, rng.randrange(5, 200))
        rows.append(frames.row(1000 + i, (text + " Idiot, " + frames.prose(rng, 5)) if bad else text))
        labels.append((1000 + i, 1, int(bad)))
    docs = frames.documents(spark, rows + frames.awkward(rng))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1001, 1, None), (1001, 1, 0)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, marks, fold("doc_id", 4) != 2)
    found = {r.doc_id: r.score for r in toxicity.score(docs, machine).where(fold("doc_id", 4) == 2).collect()}
    held = [(found[d], t) for d, _, t in labels if d in found]
    assert np.mean([(s >= 0.3) == (t == 1) for s, t in held]) > 0.97
    every = toxicity.score(docs, machine)
    assert every.count() == docs.count()
    assert every.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.accepted(docs, machine, 0.3)
    assert kept.columns == docs.columns and kept.where("lower(text) like '%idiot,%'").count() == 0
    assert toxicity.score(frames.empty(spark), machine).collect() == []


def test_toxicity_without_labels(spark):
    docs = frames.documents(spark, frames.awkward(random.Random(1)))
    machine = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert toxicity.score(docs, machine).count() == docs.count()


def test_language_held_out_and_awkward(spark):
    rng = random.Random(10)
    syllables = {"en": ["the", "ing", "and", "ou"], "de": ["sch", "ung", "ein", "ü"], "el": ["αν", "τος", "και", "ει"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80)))
        rows.append(frames.row(1000 + i, text.upper() + "!!" if i % 9 == 0 else text, lang))
    rows.append(frames.row(5, "123 456 ..."))
    docs = frames.documents(spark, rows + [r for r in frames.awkward(rng) if r[0] != 5])
    model = langid.fit(docs, fold("doc_id", 5) != 0, sample=100)
    found = langid.identify(docs, model)
    assert found.count() == docs.count()
    predicted = {r.doc_id: r for r in found.collect()}
    held = [predicted[r[0]].lang_pred == r[2] for r in rows if r[0] >= 1000]
    assert np.mean(held) > 0.97
    assert predicted[1].lang_pred == predicted[2].lang_pred == predicted[5].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in predicted.values())
    assert langid.identify(frames.empty(spark), model).collect() == []


def test_language_without_learning_rows(spark):
    docs = frames.documents(spark, frames.awkward(random.Random(1)))
    model = langid.fit(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
