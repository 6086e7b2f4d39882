"""Query of the syncmer fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.spark import table
from capsight.llm.syncmers import as_text, edited_fingerprints, likeness


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text, and their likeness."""
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE_SQL: dict[str, str] = {}
