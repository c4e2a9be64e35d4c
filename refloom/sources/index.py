"""The index on disk: Parquet tables under a versioned folder that a pointer names.

A build writes a new version and then swaps the pointer by an atomic rename, so
readers see the old index or the new one. ``forward`` is sorted by name, for
lookups; ``by_file`` holds the same rows sorted by file, for positions.
"""

from __future__ import annotations

import os
import subprocess
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import grammar

FORMAT = "refloom-index 1"
FORWARD = "anchor string, file string, start_line bigint, end_line bigint"
MENTIONS = "token string, file string, line bigint, line_ref boolean"


@dataclass(frozen=True)
class Index:
    forward: DataFrame
    by_file: DataFrame
    mentions: DataFrame
    paths: DataFrame
    built_at: int
    tree: str


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, options)


def _get(spark: SparkSession, path: str) -> str | None:
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    source = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write(path: str, forward: DataFrame, mentions: DataFrame, paths: DataFrame, tree: str = "", built_at: int | None = None, partitions: int | None = None) -> None:
    spark = forward.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = grammar.location(F.col("file"), F.col("start_line"), F.col("end_line"))
    forward = forward.select("anchor", "file", "start_line", "end_line").persist()
    try:
        # the order of a name's definitions is that of their written locations; a name in every file spreads by it
        forward.repartitionByRange(n, F.col("anchor"), place).sortWithinPartitions("anchor", place).write.parquet(f"{path}/{version}/forward")
        forward.repartitionByRange(n, "file", "start_line").sortWithinPartitions("file", "start_line").write.parquet(f"{path}/{version}/by_file")
    finally:
        forward.unpersist()
    mentions.select("token", "file", "line", "line_ref").repartitionByRange(n, "token", "file", "line").sortWithinPartitions("token", "file", "line").write.parquet(f"{path}/{version}/mentions")
    paths.select("path").repartitionByRange(n, "path").sortWithinPartitions("path").write.parquet(f"{path}/{version}/paths")
    meta = spark.createDataFrame([(FORMAT, int(time.time()) if built_at is None else built_at, tree)], "format string, built_at bigint, tree string")
    meta.coalesce(1).write.parquet(f"{path}/{version}/meta")
    _put(spark, f"{path}/CURRENT", version)


def read(spark: SparkSession, path: str) -> Index | None:
    """The index that the pointer names, or None without one; another format is an error."""
    version = _get(spark, f"{path}/CURRENT")
    if version is None:
        return None
    top = f"{path}/{version.strip()}"
    meta = spark.read.schema("format string, built_at bigint, tree string").parquet(f"{top}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError("corrupt index: unknown format")
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{top}/{name}")
    return Index(table("forward", FORWARD), table("by_file", FORWARD), table("mentions", MENTIONS), table("paths", "path string"), meta["built_at"], meta["tree"])


def git_tree(root: str) -> str:
    """The id of a clean checkout's tree, else nothing."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=False)
    try:
        status = run("status", "--porcelain")
        if status.returncode or status.stdout.strip():
            return ""
        return run("rev-parse", "HEAD^{tree}").stdout.strip()
    except OSError:
        return ""


def newest(root: str, paths: list[str]) -> int:
    """Latest change of the files, in seconds; those that are gone count as 0."""
    def changed(p: str) -> int:
        try:
            return int(os.stat(os.path.join(root, p)).st_mtime)
        except OSError:
            return 0

    return max(map(changed, paths), default=0)


def is_fresh(index: Index, files: DataFrame, skip: bool = False, tree: str = "") -> bool:
    """Cheapest first: skipped, the same clean tree, or no recorded file newer than the build.

    ``files`` has (path, modified_at). Files that came later are not recorded and are not looked at.
    """
    if skip or (tree and tree == index.tree):
        return True
    seen = files.join(index.paths, "path", "left_semi").agg(F.max(F.unix_seconds("modified_at")).alias("t")).first()["t"]
    return (seen or 0) <= index.built_at
