import random
import zlib

import numpy as np
import pyarrow as pa

from capsight.llm import text
from capsight.llm.spark import fold


def test_words_are_those_of_bytes_split():
    rng = random.Random(1)
    signs = "abAB é漢\t\n\x0b\x0c\r .,-\x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, ""]
    column = pa.array(texts)
    seen = {}
    for found in text.words(column):
        for i in range(found.n_docs):
            own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
            expected = (texts[found.first + i] or "").encode().lower().split()
            assert len(own) == len(expected)
            for h, w in zip(own, expected, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_do_not_change_hashes(monkeypatch):
    column = pa.array(["one two three", "four", "", "five six"] * 5)
    whole = np.concatenate([w.hashes for w in text.words(column)])
    monkeypatch.setattr(text, "PIECE", 7)
    assert (np.concatenate([w.hashes for w in text.words(column)]) == whole).all()
    assert (np.concatenate([w.hashes for w in text.words(column.slice(2, 9))]) == np.concatenate([w.hashes for w in text.words(pa.array(column.to_pylist()[2:11]))])).all()


def test_shingle_sets():
    found = next(text.words(pa.array(["a b a b", "a", "", "b a"])))
    values, bounds = text.shingle_sets(found, 2)
    assert np.diff(bounds).tolist() == [2, 1, 0, 1]
    assert values[bounds[3]] in values[: bounds[1]]


def test_rows_without_id_are_in_no_fold(spark):
    frame = spark.createDataFrame([(7,), (None,), (-3,)], "doc_id long")
    assert [r[0] for r in frame.select(fold("doc_id", 5)).collect()] == [zlib.crc32(b"7") % 5, -1, zlib.crc32(b"-3") % 5]
