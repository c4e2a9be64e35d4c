"""Query 10: all documents into 16 shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import sharding
from refloom.llm.tables import load

N_SHARDS = 16


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(load(spark, sf_dir, "documents"), "doc_id", N_SHARDS)
    narrow = placed.select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    return sharding.number(narrow, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op10_shards": op10_shards}
ORACLE_SQL: dict = {}
