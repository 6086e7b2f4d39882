"""Metrics that count relevant items by kind equal those of pairs."""

from pyspark.sql import functions as F

from capsight.operators import evaluation


def test_metrics_by_kind_equal_those_of_pairs(spark):
    items = [(k, None if k % 11 == 5 else k % 4 if k < 40 else 9, k % 3 + 1) for k in range(60)] + [(99, 77, 2)]
    frame = spark.createDataFrame(items, "item int, kind int, grade int")
    cases = frame.where("item % 5 = 0 or item = 99").select(F.col("item").alias("q"), "kind")
    ranking = cases.select("q", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("rank")).withColumn("item", F.pmod(F.col("q") + F.col("rank") * 7, F.lit(61)).cast("int"))
    pairs = cases.join(frame, "kind").where("item <> q").select("q", "item", "grade")
    expected = evaluation.case_metrics(ranking, pairs, ["q"], "item")
    found = evaluation.class_metrics(ranking, cases, frame, "q", "item", "kind")
    rows = lambda f: {r.q: [round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(f.columns)] for r in f.collect()}
    first = lambda f: f.withColumn("found_20", F.col("found_20").cast("long"))
    assert sorted(found.columns) == sorted(expected.columns) and rows(first(found)) == rows(first(expected)) and len(rows(found)) > 9
    labels = cases.join(frame.select("item", "kind"), "kind").select("q", "item")
    pair = evaluation.context_retention(ranking.where("rank <= 8"), labels, ["q"], "item").collect()
    assert evaluation.class_retention(ranking.where("rank <= 8"), cases, frame.select("item", "kind"), ["q"], "item", "kind").collect() == pair
