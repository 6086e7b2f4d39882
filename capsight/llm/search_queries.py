"""Query of the exact top-k search and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.spark import table
from capsight.llm.voronoi_search import top_products

EVERY, KEPT = 100, 10


def op12_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth embedding with all others."""
    return top_products(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % EVERY == 0, KEPT)


QUERIES = {"op12_voronoi_topk": op12_voronoi_topk}

OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {KEPT}
"""

ORACLE_SQL = {"op12_voronoi_topk": OP12_SQL}
