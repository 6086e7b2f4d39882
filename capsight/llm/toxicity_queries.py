"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.spark import fold, table
from capsight.llm.toxicity import fit, score

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three of four folds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", FOLDS) != HELD_OUT)
    return score(docs, machine).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
