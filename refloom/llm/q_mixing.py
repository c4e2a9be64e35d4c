"""Query 2: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import mixing
from refloom.llm.tables import load

SEED, EPOCHS, SHARE = 7, 4, (3, 4)
#: Source names end in a number; the first is the crawl, the next four are forums, others reference works.
WEIGHTS = {"domain": {"crawl": 2, "forum": 3, "reference": 5}, "language": {"en": 6, "de": 2, "fr": 2, "es": 2}}


def domain(source: Column) -> Column:
    return F.when(source == "src0", "crawl").when(source.isin("src1", "src2", "src3", "src4"), "forum").otherwise("reference")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": domain(F.col("source")), "language": F.col("lang"), "origin": F.col("source")}
    return mixing.mix(load(spark, sf_dir, "documents"), levels, WEIGHTS, SHARE, EPOCHS, SEED).withColumnRenamed("id", "doc_id")


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END" if weights else "1"


def _level(name: str, above: list[str], column: str, source: str) -> str:
    """The SQL of one level's deal: children of ``source`` (above, budget)."""
    here = ", ".join([*above, column])
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM n.{c}" for c in above) or "true"
    by = f"PARTITION BY {', '.join(above)}" if above else ""
    order = f"{by} ORDER BY ratio, {column} NULLS FIRST"
    s = ", ".join(f"s.{c}" for c in [*above, column])
    return f"""
{name}_s AS (SELECT {here}, sum(capacity)::BIGINT AS capacity, {_cases(column, WEIGHTS.get(column, {}))}::BIGINT AS weight FROM leaves GROUP BY {here}),
{name}_c AS (SELECT {s}, capacity, weight, n.budget, CASE WHEN weight > 0 THEN capacity / weight ELSE -1 END AS ratio,
    CASE WHEN weight > 0 THEN capacity ELSE 0 END AS usable FROM {name}_s s JOIN {source} n ON {same}),
{name}_w AS (SELECT *, budget - coalesce(sum(usable) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER ({order}) AS n FROM {name}_c),
{name}_f AS (SELECT *, min(CASE WHEN usable * rest > left_ * weight THEN n END) OVER ({by}) AS first_n FROM {name}_w),
{name}_g AS (SELECT *, max(CASE WHEN n = first_n THEN left_ END) OVER ({by}) AS share_left, max(CASE WHEN n = first_n THEN rest END) OVER ({by}) AS share_rest FROM {name}_f),
{name} AS (SELECT {here}, (CASE WHEN first_n IS NULL OR n < first_n THEN usable ELSE least((share_left * weight) // share_rest, usable) END)::BIGINT AS budget FROM {name}_g)"""


QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {
    "op2_mixing": rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4') THEN 'forum' ELSE 'reference' END AS domain,
    lang AS language, source AS origin, len([w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''])::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS uniq, sum(n_tokens)::BIGINT * {EPOCHS} AS capacity FROM d GROUP BY ALL),
top AS (SELECT (sum(uniq) * {SHARE[0]} // {SHARE[1]})::BIGINT AS budget FROM leaves),
{_level("l1", [], "domain", "top")},
{_level("l2", ["domain"], "language", "l1")},
{_level("l3", ["domain", "language"], "origin", "l2")},
p AS (
  SELECT leaves.*, CASE WHEN uniq > 0 THEN budget // uniq ELSE 0 END AS whole, CASE WHEN uniq > 0 THEN budget % uniq ELSE 0 END AS part
  FROM leaves JOIN l3 ON leaves.domain = l3.domain AND leaves.language IS NOT DISTINCT FROM l3.language AND leaves.origin IS NOT DISTINCT FROM l3.origin),
q AS (
  SELECT d.*, whole, part, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM d JOIN p ON d.domain = p.domain AND d.language IS NOT DISTINCT FROM p.language AND d.origin IS NOT DISTINCT FROM p.origin),
r AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before FROM q)
SELECT doc_id, domain, language, origin, n_tokens, (whole + CASE WHEN before < part THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r WHERE whole + CASE WHEN before < part THEN 1 ELSE 0 END > 0""",
}
