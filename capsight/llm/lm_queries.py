"""Query of the language-model scores, and SQL of its base columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.language_model import learn, score
from capsight.llm.spark import discard, fold, table

FOLDS, HELD_OUT = 7, 2


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from six of seven folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    automaton, gains = learn(docs, fold("doc_id", FOLDS) != HELD_OUT)
    scores = score(docs, automaton, gains)
    discard(gains)
    return scores.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(automaton.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


QUERIES = {"op6_lm_scores": op6_lm_scores}
ORACLE_SQL: dict[str, str] = {}
