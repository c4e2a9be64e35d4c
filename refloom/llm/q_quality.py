"""Query 3: every document's expected grade.

The grades follow from the labels: 0 for low quality, 1 for good quality that is
toxic, 2 for good quality that isn't. Documents are kept at P(grade >= 1) >= 1/2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import quality
from refloom.llm.tables import load

GRADES, TAIL, LEAST = 3, 1, 0.5


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    ratings = load(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    model = quality.train(docs, ratings, GRADES)
    scored = quality.score(docs.select("doc_id", "text"), model, TAIL)
    return scored.select("doc_id", (quality.remainder("doc_id") == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= LEAST).alias("keep"))


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict = {}
