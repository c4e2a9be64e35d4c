"""Query 1: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import simhash
from refloom.llm.tables import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(found["id"].alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict = {}
