"""Query 7: all documents to a token store and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import tokenstore
from refloom.llm.scratch import fresh
from refloom.llm.tables import load

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op7_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh(spark, "tokenstore")
    tokenstore.write(load(spark, sf_dir, "documents"), path, str(public_tokenizers.path(TOKENIZER)), END_ID)
    return tokenstore.checksums(spark, path).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_tokenstore": op7_tokenstore}
ORACLE_SQL: dict = {}
