"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a pseudo-random score; a record goes to the shard
with the highest one. Adding a shard moves exactly the records for which the
new shard's score is highest, all of them into the new shard; removing one
moves only its own records. Weights scale a shard's expected part.

Placement is a projection: no shuffle. Slots (gapless positions within a shard)
need an order over all rows, done in two levels over narrow rows: equal rows
are counted first, so that a key that holds a third of all rows is one row,
then ranges of the order are numbered independently and shifted by the counts
of the ranges before them.

Defined cases: a null text has size 1 and the checksum of no bytes; a null key
is a key of its own; equal rows are kept and get neighbouring slots; an empty
table gives an empty table; other columns of the input pass through ``assign``
unless they bear the name of an output column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.scratch import cut

_HEX = 13  # 52 bits, so that the fraction is exact in a double


def _score(key: Column, shard: int, weight: float) -> Column:
    """log(u) / weight for u in (0, 1): its maximum falls to a shard with probability weight / sum."""
    digits = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    number = F.conv(F.substring(digits, 1, _HEX), 16, 10).cast("bigint")
    return F.log((number + F.lit(0.5)) / F.lit(float(16**_HEX))) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the winner; equal scores go to the higher shard."""
    scored = [F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not scored:
        raise ValueError("no shard has a positive weight")
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def assign(df: DataFrame, key: Column | str, n_shards: int = 16, weights: Sequence[float] | None = None, text_col: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard and grown_shard (the shard with one more of mean weight)."""
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards or min(weights) < 0:
        raise ValueError("one weight of 0 or more is needed for each shard")
    key = F.col(key) if isinstance(key, str) else key
    text_key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    more = sum(weights) / n_shards
    grown = F.struct(_score(F.col("_key"), n_shards, more).alias("score"), F.lit(n_shards).alias("shard"))
    body = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.withColumn("_key", text_key)
        .withColumn("_best", _best(F.col("_key"), weights))
        .withColumns({"size": F.octet_length(body).cast("bigint") + 1, "text_crc32": F.crc32(body.cast("binary")), "law": F.lit("key")})
        .withColumns({"shard": F.col("_best.shard"), "grown_shard": F.greatest(F.col("_best"), grown)["shard"]})
        .drop("_key", "_best")
    )


def number(df: DataFrame, shard_col: str, order_cols: Sequence[str]) -> DataFrame:
    """All rows of ``df`` with ``slot``: 0, 1, ... within each shard in ascending ``order_cols``, then by all columns.

    ``df`` should be narrow; equal rows are one row until the end.
    """
    names = [shard_col, *order_cols, *(c for c in df.columns if c not in {shard_col, *order_cols})]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counted.repartitionByRange(parts, *names).withColumn("_range", F.spark_partition_id()), "slots")
    ahead = Window.partitionBy(shard_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range", shard_col).agg(F.sum("_n").alias("_rows")).withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    within = Window.partitionBy("_range", shard_col).orderBy(*(F.col(c).asc_nulls_first() for c in names[1:])).rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = first.join(offsets.select("_range", F.col(shard_col).alias("_shard"), "_ahead"), ["_range"], "inner").where(F.col("_shard") == F.col(shard_col))
    start = F.col("_ahead") + F.col("_before")
    return placed.select(*df.columns, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int = 16, key: str = "doc_id", salts: int = 8, weights: Sequence[float] | None = None) -> None:
    """Write whole rows under path/shard=N; each shard is written by ``salts`` tasks."""
    placed = assign(df, key, n_shards, weights)
    salt = F.pmod(F.xxhash64(key, "text_crc32"), F.lit(salts))
    placed.repartition(n_shards * salts, "shard", salt).write.partitionBy("shard").parquet(path)
