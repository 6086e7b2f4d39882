"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.secret_scan import KINDS, find_secrets, joined
from capsight.llm.spark import table

BASE = KINDS[:3]


def _of(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, with counts and a digest of the base kinds."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = [F.size(_of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    digest = F.sha2(joined(_of(*BASE)), 256).alias("base_sha256")
    return found.select("doc_id", *count, digest, joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL: dict[str, str] = {}
