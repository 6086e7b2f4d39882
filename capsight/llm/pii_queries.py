"""Query of the personal-data finder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.pii import KINDS, N_BASE, find_personal_data, joined
from capsight.llm.spark import table


def _only(*kinds: int) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents, with counts and a digest of the base kinds."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(_only(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(N_BASE)]
    digest = F.sha2(joined(_only(*range(N_BASE))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL: dict[str, str] = {}
