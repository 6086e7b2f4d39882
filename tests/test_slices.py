"""What Python holds at a time doesn't grow with a batch."""

from pyspark.sql import functions as F

from capsight.functions import nested
from capsight.operators import knowledge


def test_leaves_and_masks_come_in_slices():
    import pyarrow as pa

    texts, sizes = ['{"a": 1, "b": ["x", null]}', None, "{broken", "[]", "3"] * 200, []
    made = lambda some: sizes.append(len(some)) or nested._leaf_rows(some)
    found = nested._in_slices(pa.array(texts), made, pa.list_(nested._ROW)).to_pylist()
    assert max(sizes) == nested.SLICE and sum(sizes) == 1000
    leaf = lambda *v: dict(zip(("path", "kind", "value"), v, strict=True))
    assert found == [[leaf("a", "number", "1"), leaf("b[0]", "string", "x"), leaf("b[1]", "null", None)], None, None, [], []] * 200
    assert nested._in_slices(pa.array([], pa.string()), made, pa.list_(nested._ROW)).to_pylist() == []


def test_chunks_of_a_batch_of_many_slices(spark):
    rows = [(k, None if k % 50 == 0 else "x" if k % 3 else "word. " * 400) for k in range(700)]
    found = knowledge.chunks(spark.createDataFrame(rows, "k long, t string").coalesce(1), "k", "t").select("k", "chunk_index", "content").collect()
    of = {}
    for r in sorted(found):
        of.setdefault(r.k, []).append(r.content)
    long = knowledge.pack([*["word."] * 400, ""])
    assert of == {k: long if len(t) > 1 else ["x"] for k, t in rows if t is not None}
    assert spark.createDataFrame([(1, None)], "k long, t string").transform(lambda f: knowledge.chunks(f, "k", "t")).agg(F.count("*")).head()[0] == 0
