"""Query 9: exact nearest neighbours of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import vafile
from refloom.llm.tables import load

K = 5


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vafile.build(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vafile.search(index, index.where(F.col("id") % 50 == 0), K)


QUERIES = {"op9_topk": op9_topk}
ORACLE_SQL = {
    "op9_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
