"""Retrieval-quality queries: nearest vectors as rankings, vectors of the same label as relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.operators import evaluation, knowledge
from capsight.plans.tables import table

EVERY, DEPTH = 20, 20
#: The release policy: metric, kind of limit, limit, whether it blocks.
POLICY = (("recall_5", "min", 0.01, True), ("ndcg_20", "exclusive_min", 0.9, False), ("no_result_rate", "max", 0.5, True), ("reciprocal_rank", "regression", 0.05, True))
BASELINE = 0.5


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % EVERY == 0)
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    ranking = knowledge.nearest(vectors, "vec_id", "embedding", queries, DEPTH, others=True)
    items = vectors.select("vec_id", "label", (F.col("vec_id") % 3 + 1).alias("grade"))
    return evaluation.class_metrics(ranking, asked.select(F.col("vec_id").alias("query_id"), "label"), items, "query_id", "vec_id", "label")


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, hits, NDCG and first relevant rank of each query."""
    found = _cases(spark, sf_dir)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in found.dtypes])


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of these, by parity of the query."""
    return evaluation.summarised(_cases(spark, sf_dir).withColumn("odd", F.col("query_id") / EVERY % 2 == 1), "odd")


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [p[0] for p in POLICY]
    totals = evaluation.summarised(_cases(spark, sf_dir))
    metrics = totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(BASELINE).alias("baseline")) for n in names])))
    policy = spark.createDataFrame(list(POLICY), "metric string, kind string, threshold double, blocking boolean")
    return evaluation.gates(metrics, policy)


def gate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate with its value and outcome."""
    return _gates(spark, sf_dir).select("metric", "kind", "threshold", "blocking", "value", "passed")


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the blocking gates pass."""
    return evaluation.verdict(_gates(spark, sf_dir))


def rerank_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a made-up reranking, which moves each query's first relevant rank by its id."""
    before, after = F.col("first_rank"), F.col("first_rank") + F.col("query_id") % 3 - 1
    outcome = evaluation.rerank_outcome(before, after, F.col("query_id") % 7 == 0)
    return _cases(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only documents, or only labels, have."""
    return evaluation.uncovered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def judge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as repeated judgements of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "source", F.col("quality").cast("double").alias("score"), (F.col("quality") == 1).alias("passed"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("violations"), F.lit(1).alias("cost"),
    )
    return evaluation.merged_judgements(rows, "source").withColumn("violations", F.array_join("violations", ","))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often quality agrees with its opposite of toxicity."""
    labels = table(spark, sf_dir, "labels")
    right = labels.select("doc_id", (1 - F.col("toxic")).alias("quality"))
    return evaluation.agreement(labels, right, "doc_id", "quality").withColumn("quality_agreement", F.round("quality_agreement", 6))


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that occur more than once."""
    return evaluation.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")).where("digest is not null"), "digest")


QUERIES = {
    f.__name__: f
    for f in (case_metrics, ir_metrics, gate_policy, gate_verdict, rerank_compare, missing_labels, judge_merge, label_agreement, repeated_texts)
}


def _cut(k: int) -> str:
    return f"""count(*) FILTER (rank <= {k}) / count(*) AS recall_{k}, CAST(coalesce(max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS BIGINT) AS hit_{k},
        coalesce(sum(CASE WHEN rank <= {k} THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END), 0)
        / sum(CASE WHEN ideal <= {k} THEN (2 ** grade - 1) / log2(ideal + 1) ELSE 0 END) AS ndcg_{k}"""


_CASES = f"""
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS score
          FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {DEPTH}),
    l AS (SELECT a.vec_id AS query_id, b.vec_id, b.vec_id % 3 + 1 AS grade FROM embeddings a JOIN embeddings b USING (label)
          WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
    i AS (SELECT l.*, rank, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, vec_id) AS ideal FROM l LEFT JOIN r USING (query_id, vec_id)),
    c AS (SELECT query_id, count(*) AS n_relevant, min(rank) AS first_rank, {", ".join(_cut(k) for k in evaluation.CUTS)},
                 count(*) FILTER (rank <= 20) AS found_20, coalesce(1.0 / min(rank), 0)::DOUBLE AS reciprocal_rank FROM i GROUP BY 1)"""
_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in [f"{m}_{k}" for k in evaluation.CUTS for m in ("recall", "hit", "ndcg")] + ["reciprocal_rank"])
_SUMMARY = f"""count(*) AS n_cases, {_MEANS}, round(sum(found_20) / sum(n_relevant), 6) AS micro_recall_20,
    round(avg(CAST(found_20 = 0 AS INT)), 6) AS no_result_rate"""
_GATES = f"""{_CASES}, m AS (SELECT {_SUMMARY} FROM c),
    p(metric, kind, threshold, blocking) AS (VALUES {", ".join(f"('{m}', '{k}', {t}::DOUBLE, {b})" for m, k, t, b in POLICY)}),
    v AS (SELECT p.*, CASE metric {" ".join(f"WHEN '{p[0]}' THEN m.{p[0]}" for p in POLICY)} END AS value FROM p, m),
    g AS (SELECT *, CASE kind WHEN 'min' THEN value >= threshold WHEN 'exclusive_min' THEN value > threshold WHEN 'max' THEN value <= threshold
                    ELSE value >= {BASELINE} - threshold END AS passed FROM v)"""

ORACLE_SQL = {
    "case_metrics": f"""WITH {_CASES} SELECT query_id, n_relevant, first_rank, {", ".join(f"round(recall_{k}, 6) AS recall_{k}, hit_{k}, round(ndcg_{k}, 6) AS ndcg_{k}" for k in evaluation.CUTS)},
        found_20, round(reciprocal_rank, 6) AS reciprocal_rank FROM c""",
    "ir_metrics": f"WITH {_CASES} SELECT query_id // {EVERY} % 2 = 1 AS odd, {_SUMMARY} FROM c GROUP BY 1",
    "gate_policy": f"WITH {_GATES} SELECT metric, kind, threshold, blocking, value, passed FROM g",
    "gate_verdict": f"WITH {_GATES} SELECT bool_and(passed OR NOT blocking) AS released, count(*) FILTER (passed) AS n_passed, count(*) AS n_gates FROM g",
    "rerank_compare": f"""WITH {_CASES}, o AS (SELECT query_id, CASE WHEN first_rank <= 20 THEN first_rank ELSE 21 END AS b,
          CASE WHEN first_rank + query_id % 3 - 1 <= 20 THEN first_rank + query_id % 3 - 1 ELSE 21 END AS a FROM c)
        SELECT CASE WHEN query_id % 7 = 0 THEN 'degraded' WHEN a < b THEN 'improved' WHEN a > b THEN 'regressed' ELSE 'unchanged' END AS outcome, count(*) AS n FROM o GROUP BY 1""",
    "missing_labels": """SELECT DISTINCT doc_id, 'actual' AS missing_from FROM documents ANTI JOIN labels USING (doc_id)
        UNION ALL SELECT DISTINCT doc_id, 'expected' FROM labels ANTI JOIN documents USING (doc_id)""",
    "judge_merge": """SELECT source, min(quality)::DOUBLE AS score, bool_and(quality = 1) AS passed, CASE WHEN max(toxic) = 1 THEN 'toxic' ELSE '' END AS violations,
        count(DISTINCT quality = 1) > 1 AS uncertain, count(*) AS cost, count(*) AS n_judgements FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "label_agreement": """SELECT count(*) AS n_cases, round(avg(CAST(a.quality IS NOT DISTINCT FROM 1 - b.toxic AS INT)), 6) AS quality_agreement
        FROM labels a JOIN labels b USING (doc_id)""",
    "repeated_texts": "SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
