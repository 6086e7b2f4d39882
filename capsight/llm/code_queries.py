"""Query of the vector codes and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.spark import table
from capsight.llm.vector_codes import ENTRIES, PARTS, ROUNDS, compress, with_group_total


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every embedding under codebooks of the whole table."""
    found = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return with_group_total(found.codes, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256")
    )


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _round(number: int) -> str:
    """Nearest entries of all parts under codebook ``number``, by all distances; and the next codebook."""
    return f"""
a{number} AS MATERIALIZED (
  SELECT v.vec_id, v.part, arg_min({{entry: c.entry, x: v.x}}, {{d: (v.xx + c.xx - 2 * list_dot_product(v.x, c.x))::BIGINT, e: c.entry}}) AS best,
         min((v.xx + c.xx - 2 * list_dot_product(v.x, c.x))::BIGINT) AS d
  FROM parts v JOIN c{number} c USING (part) GROUP BY v.vec_id, v.part),
s{number} AS (
  SELECT part, entry, list(floor(total / n) ORDER BY pos) AS x FROM (
    SELECT part, best.entry AS entry, pos, sum(best.x[pos]) AS total, count(*) AS n FROM a{number}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS pos)
    GROUP BY ALL)
  GROUP BY ALL),
c{number + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(s.x, c.x) AS x, list_dot_product(coalesce(s.x, c.x), coalesce(s.x, c.x)) AS xx
  FROM c{number} c LEFT JOIN s{number} s USING (part, entry)),"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x, list_dot_product(x, x) AS xx
  FROM kept, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x, xx FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{"".join(_round(n) for n in range(ROUNDS + 1))}
e AS (
  SELECT a.vec_id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} a JOIN kept USING (vec_id) GROUP BY a.vec_id),
h AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h
"""

ORACLE_SQL = {"op11_vector_codes": OP11_SQL}
