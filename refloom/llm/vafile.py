"""Exact top-k search by inner product over a vector-approximation file.

The index keeps, beside each exact vector, a cell number of CELL_BITS bits for
every component. A search scans the cells of a partition, from which follow a
lower and an upper bound of every inner product; the exact vectors are then
read in descending order of the upper bound, until no unread bound reaches the
k-th score found. Bounds are exact integers, so the answer is the same as that
of a full scan; equal scores go to the smaller id, for which a bound equal to
the k-th score is still read.

Queries come in blocks of at most QUERY_BLOCK; a block is what a task holds
besides a batch of vectors, whatever the number of queries. Each partition
answers with k rows for a query at most, and these are merged by rank.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do vectors whose length differs from that of most
queries' block (they could have no inner product with them); a query without
candidates has no rows; repeated ids are separate candidates, and as queries give
the best of all their vectors together; a query's own id
is never its candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
CELL_BITS = 6
QUERY_BLOCK = 2048
#: Vectors of a partition whose cells are bounded at once.
BATCH = 4096


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of every component, as 64-bit integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def build(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, exact, cells): the exact integer components, and the cell of each, its number times the cell's width.

    A cell spans 2**shift neighbouring integers, with the shift that fits the vector's greatest component into CELL_BITS.
    """
    good = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector_col)).alias("exact"))
    reach = F.array_max(F.transform("exact", lambda x: F.abs(x))) + 1
    shift = F.greatest(F.ceil(F.log2(reach * 2)).cast("int") - CELL_BITS, F.lit(0))
    sized = good.withColumn("dim", F.size("exact")).withColumn("width", F.call_function("shiftleft", F.lit(1).cast("bigint"), shift))
    return sized.withColumn("cells", F.transform("exact", lambda x: F.floor(x / F.col("width")).cast("bigint")))


def _block_search(batches: Iterator[pd.DataFrame], query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The best k of this partition for each query of a block."""
    n = len(query_ids)
    best_score = np.full((n, 0), 0, dtype=np.int64)
    best_id = np.full((n, 0), 0, dtype=np.int64)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    up_sum, down_sum = up.sum(axis=1), down.sum(axis=1)

    def offer(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, valid: np.ndarray):
        """Merge candidates (one row of them for each of ``rows``) into the best; what isn't valid ranks last and is cut off later."""
        nonlocal best_score, best_id
        width = max(k, 1)
        if best_score.shape[1] < width:
            fill = width - best_score.shape[1]
            best_score = np.hstack([best_score, np.full((n, fill), _NONE)])
            best_id = np.hstack([best_id, np.full((n, fill), _LAST)])
        s = np.hstack([best_score[rows], np.where(valid, score, _NONE)])
        i = np.hstack([best_id[rows], np.where(valid, ids, _LAST)])
        order = np.lexsort((i, -s), axis=1)[:, :width]
        best_score[rows] = np.take_along_axis(s, order, axis=1)
        best_id[rows] = np.take_along_axis(i, order, axis=1)

    for pdf in batches:
        pdf = pdf[pdf["dim"].to_numpy() == queries.shape[1]]
        for lo in range(0, len(pdf), BATCH):
            part = pdf.iloc[lo : lo + BATCH]
            ids = part["id"].to_numpy()
            width = part["width"].to_numpy().astype(np.float64)
            cells = np.stack(part["cells"].to_numpy()).astype(np.float64) * width[:, None]
            exact = part["exact"].to_numpy()
            # a component lies in [cell, cell + width - 1]; the sums are integers below 2**53, exact in doubles
            at = queries @ cells.T
            upper = at + up_sum[:, None] * (width - 1)[None, :]
            own = query_ids[:, None] == ids[None, :]
            upper[own] = _NONE
            # visit in descending upper bound, a few at a time, while some bound still reaches the k-th score
            order = np.argsort(-upper, axis=1, kind="stable")
            bound = np.take_along_axis(upper, order, axis=1)
            done, step, vectors = 0, max(4 * k, 16), None
            rows = np.arange(n)
            while len(rows) and done < len(ids):
                stop = min(done + step, len(ids))
                if best_score.shape[1]:
                    rows = rows[bound[rows, done] >= best_score[rows, -1]]
                    if not len(rows):
                        break
                if vectors is None:
                    vectors = np.stack(exact).astype(np.float64)
                which = order[rows, done:stop]
                score = np.einsum("qd,qcd->qc", queries[rows], vectors[which], optimize=True) if len(rows) * (stop - done) < 200_000 else np.stack([vectors[w] @ queries[r] for r, w in zip(rows, which, strict=True)])
                offer(rows, score.astype(np.int64), ids[which], ~own[rows[:, None], which])
                done, step = stop, step * 2
    if best_score.shape[1]:
        q, c = np.nonzero(best_id != _LAST)
        yield pd.DataFrame({"query_id": query_ids[q], "vec_id": best_id[q, c], "score": best_score[q, c]})


_NONE = np.iinfo(np.int64).min // 2
_LAST = np.iinfo(np.int64).max


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for each row of ``queries`` (id, exact), itself excluded by id."""
    spark = index.sparkSession
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    total = queries.count()
    n_blocks = -(-total // QUERY_BLOCK)
    found = spark.createDataFrame([], schema)
    # blocks are cut by a hash with room to spare, so that each stays near QUERY_BLOCK rows; one block at a time is on the driver
    for block in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).select("id", "exact").orderBy("id").toPandas()
        for dim in sorted({len(v) for v in rows["exact"]}):
            same = rows[[len(v) == dim for v in rows["exact"]]]
            ids, matrix = same["id"].to_numpy().astype(np.int64), np.stack(same["exact"].to_numpy()).astype(np.float64)

            def local(batches, ids=ids, matrix=matrix):
                return _block_search(batches, ids, matrix, k)

            found = found.union(index.select("id", "dim", "width", "cells", "exact").mapInPandas(local, schema))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
