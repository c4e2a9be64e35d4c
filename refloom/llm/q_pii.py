"""Query 6: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import pii
from refloom.llm.tables import load


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))
    counts = [pii.count("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict = {}
