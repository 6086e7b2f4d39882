"""Query of source mixing and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.mixing import MOST, SALTS, UNIT, mix
from capsight.llm.spark import table


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


QUERIES = {"op9_mixing": op9_mixing}

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT *, source_size * {MOST} AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
h AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS share
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT share AS level FROM h WHERE ratio > share ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM v) * weight, cap::DOUBLE)) AS target FROM h),
u AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN size > 0 THEN round(t.target * {UNIT} / t.source_size) ELSE 0 END::BIGINT AS expected,
         length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 8))::BIGINT % {SALTS} AS salt,
         ('0x' || left(md5('1:' || coalesce(d.source, '')), 8))::BIGINT % {UNIT} AS shift
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, shift + sum(expected) OVER (PARTITION BY source ORDER BY class DESC, salt, size DESC, doc_id NULLS FIRST
                                        ROWS UNBOUNDED PRECEDING) AS reached FROM u)
SELECT doc_id, size, source_size, target,
       (size * (floor(reached / {UNIT}.0) - floor((reached - expected) / {UNIT}.0)))::BIGINT AS taken FROM p
"""

ORACLE_SQL = {"op9_mixing": OP9_SQL}
