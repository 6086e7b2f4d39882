"""The filter audit against its SQL, and against a walk through the documents filter by filter."""

import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import types as T

from capsight.llm.filter_audit import audit
from capsight.llm.filter_queries import OP13_SQL, op13_filter_audit
from tests.llm import frames

LABELS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "quality", "toxic", "n", "mask")])
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def walked(rows, labels):
    """Every order by walking through all documents; failures straight from the definitions."""
    good = {d for d, quality, *_ in labels if d is not None and quality == 1}
    toxic = {d for d, _, toxic, *_ in labels if d is not None and toxic == 1}
    fails = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            found.add("C")
        if set(text) & set("#$%&*|"):
            found.add("D")
        if doc is not None and any(other is not None and other < doc and (t or "") == text for other, t, *_ in rows):
            found.add("E")
        fails.append((lang or "", doc, found))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in fails}:
            left = [(d, f) for p, d, f in fails if p == part]
            everything, gone = left, []
            for step, letter in enumerate(order, 1):
                removed = [(d, f) for d, f in left if letter in f]
                kept = [(d, f) for d, f in left if letter not in f]
                out[part, order, step] = (
                    len(kept), len(removed), sum(letter in f for _, f in gone), sum(f == {letter} for _, f in everything),
                    sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed),
                )
                shapley[part, letter] += len(removed)
                left, gone = kept, gone + removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def planted(rng):
    rows = frames.awkward(rng)
    for k in range(100, 400):
        words = frames.prose(rng, rng.choice([0, 3, 199, 200, 201])).split()
        if rng.random() < 0.4:
            words = [w[:2] for w in words]
        if rng.random() < 0.4:
            words = [w.upper() for w in words]
        if words and rng.random() < 0.4:
            words[rng.randrange(len(words))] += rng.choice("#$%&*|")
        rows.append(frames.row(k, rng.choice([" ", "\t\n", "\x0b "]).join(words), rng.choice(["en", "de", "", None])))
    same = frames.prose(rng, 210)
    rows += [frames.row(k, same, rng.choice(["en", "de"])) for k in range(500, 620)]  # a hot group of copies
    return rows + rng.sample(rows, 60) + [frames.row(k, None, "fr") for k in (700, 699, 701)]


def test_same_as_a_walk_through_the_documents(spark, tmp_path):
    rng = random.Random(13)
    rows = planted(rng)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1]), 5, 6) for d, *_ in rng.choices(rows, k=300)] + [(None, 1, 1, 0, 0)]
    docs, marks = frames.documents(spark, rows), spark.createDataFrame(labels, LABELS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    assert as_dict(op13_filter_audit(spark, str(tmp_path))) == walked(rows, labels)


def test_same_as_sql(spark):
    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = op13_filter_audit(spark, str(folder))
    expected = con.execute(f"SELECT {','.join(found.columns)} FROM ({OP13_SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit(frames.empty(spark), none).count() == 0
    rows = [frames.row(1, None, None), frames.row(2, "", "")]
    assert as_dict(audit(frames.documents(spark, rows), none)) == walked(rows, [])


@pytest.mark.parametrize("text", ["", " ", "a" * 10, "A b\u2003c É", "|"])
def test_single_rows(spark, text):
    rows = [frames.row(1, text)]
    assert as_dict(audit(frames.documents(spark, rows), spark.createDataFrame([(1, 1, 0, 0, 0)], LABELS))) == walked(rows, [(1, 1, 0)])
