"""Connected components by randomised contraction.

Each round every node picks the neighbour (or itself) of least hash under that
round's seed, and the graph is contracted along the picks. The order is drawn
anew each round, so the number of nodes falls by a constant factor in
expectation whatever the shape: chains take logarithmically many rounds, stars
one or two. Every round is a partial aggregate, two joins and a distinct, on a
graph that keeps shrinking; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.scratch import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is some node of the same component.

    Edges are undirected; loops, nulls, repeated and reversed edges do no harm.
    No edges: an empty table.
    """
    graph = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y"))).distinct(), "edges")
    picks: list[DataFrame] = []
    while True:
        seed = F.lit(len(picks) + 1)
        both = graph.union(graph.select("y", "x"))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        least = both.groupBy("x").agg(F.min(rank("y")).alias("near"))
        picks.append(cut(least.select(F.col("x").alias("node"), F.least(rank("x"), F.col("near"))["id"].alias("root")), "picks"))
        to = picks[-1]
        ends = graph.join(to.select(F.col("node").alias("x"), F.col("root").alias("p")), "x").join(to.select(F.col("node").alias("y"), F.col("root").alias("q")), "y")
        left = ends.where(F.col("p") != F.col("q")).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
        graph = cut(left, "edges")
        if graph.isEmpty():
            break
    found = picks[0]
    for later in picks[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
