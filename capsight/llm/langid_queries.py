"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capsight.llm.langid import fit, identify
from capsight.llm.spark import fold, table

FOLDS, HELD_OUT = 5, 0


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs, fold("doc_id", FOLDS) != HELD_OUT))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_langid": op10_langid}
ORACLE_SQL: dict[str, str] = {}
