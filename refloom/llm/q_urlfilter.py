"""Query 4: a verdict for every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import urlfilter
from refloom.llm.tables import load
from refloom.llm.urlfilter import Rule

RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(load(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _fit(what: str) -> str:
    arms = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"CASE {arms} END"


QUERIES = {"op4_urlfilter": op4_urlfilter}
#: The tables' pages hold neither canonical links nor refresh tags, so the aliases of a url are those of its normal form.
ORACLE_SQL = {
    "op4_urlfilter": rf"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
b AS (
  SELECT *, {_fit("text")} AS rule, {_fit("action")} AS own,
    array_to_string([p FOR p IN string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&') IF NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)=')], '&') AS query
  FROM a),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?)+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS node
  FROM b),
d AS (SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' ELSE 'block' END AS inherited FROM c WHERE node IS NOT NULL AND own IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, inherited, 'allow') AS verdict FROM c LEFT JOIN d USING (node)""",
}
