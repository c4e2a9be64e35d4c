"""Keeping an index up with changing files.

Changed files come as a stream of (path, content); each micro-batch replaces the
rows of its files and publishes a new version, so readers never see half a batch.
A null content removes the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.operators import extract, scan
from refloom.sources import index as store


def upsert(changes: DataFrame, index_path: str, built_at: int | None = None) -> None:
    """Replace the rows of the changed files. Of several changes to one file in a batch, the greatest ``at`` counts, if there is such a column."""
    spark = changes.sparkSession
    order = F.col("at").desc() if "at" in changes.columns else F.lit(0)
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(order))).where("_n = 1").select("path", "content").persist()
    try:
        live = last.where("content is not null")
        forward, mentions, paths = extract.anchors(live), scan.mention_table(live), live.select("path")
        old = store.read(spark, index_path)
        if old is not None:
            gone = last.select(F.col("path").alias("_gone"))
            forward = old.forward.join(gone, F.col("file") == F.col("_gone"), "left_anti").unionByName(forward.select("anchor", "file", "start_line", "end_line"))
            mentions = old.mentions.join(gone, F.col("file") == F.col("_gone"), "left_anti").unionByName(mentions)
            paths = old.paths.join(gone, F.col("path") == F.col("_gone"), "left_anti").unionByName(paths)
        store.write(index_path, forward, mentions, paths, "", built_at)
    finally:
        last.unpersist()


def follow(changes: DataFrame, index_path: str, checkpoint: str):
    """Start the stream; the returned query may be awaited or stopped."""
    return changes.writeStream.foreachBatch(lambda batch, _: upsert(batch, index_path)).option("checkpointLocation", checkpoint).start()
