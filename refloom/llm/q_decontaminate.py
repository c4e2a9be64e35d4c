"""Query 5: benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import decontaminate
from refloom.llm.tables import load


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans", "text_hash")


_WORDS = """[w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> '']"""
QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL = {
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, least(len(w), 1)))) AS i)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)),
found AS (SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, phrase)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, n, i FROM found) f, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)""",
}
