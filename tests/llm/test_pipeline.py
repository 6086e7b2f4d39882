"""The whole pipeline on a small corpus with planted cases, and its stages on empty tables."""

import random

import corpus_pipeline
from tests.llm import frames


def test_planted_cases(spark, tmp_path):
    rng = random.Random(18)
    clean = [frames.row(k, frames.prose(rng, rng.randrange(20, 90)), source=rng.choice("abc")) for k in range(300)]
    toxic = [frames.row(1000 + k, frames.prose(rng, 30) + " idiot " + frames.prose(rng, 10)) for k in range(60)]
    copies = [frames.row(2000 + k, clean[k][1] + (" tail" if k % 2 else ""), source="b") for k in range(30)]
    items = [(k, frames.prose(rng, 25)) for k in range(5)]
    leaks = [frames.row(3000 + k, frames.prose(rng, 10) + " " + items[k][1]) for k in range(5)]
    private = [frames.row(4000, "write to a.b@example.com or " + frames.prose(rng, 20))]
    labels = [(r[0], 1, 0) for r in clean] + [(r[0], 1, 1) for r in toxic]
    frames.documents(spark, clean + toxic + copies + leaks + private).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    ids = lambda rows: {r[0] for r in rows}
    assert not seen["toxicity"] & ids(toxic) and seen["toxicity"] >= ids(clean + copies + leaks + private)
    assert not seen["near_duplicates"] & ids(copies) and seen["near_duplicates"] >= ids(clean + leaks + private)
    assert seen["decontamination"] == ids(clean + private) == seen["personal_data"]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(ran.select("doc_id", "copy").collect()) == sorted(docs.select("doc_id", "copy").collect())
    text = [r.text for r in spark.read.parquet(f"{tmp_path}/3").where("doc_id = 4000").collect()]
    assert text[0].startswith("write to [EMAIL] or ")


def test_empty_tables(spark, tmp_path):
    frames.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
