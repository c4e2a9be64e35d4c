"""Shared scratch tables: where long plans are cut.

A cut is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and every executor can read. A lost
executor therefore never takes an intermediate result with it. Results returned
by the operators read such tables lazily, so the folder must outlive the
results; ``clear`` drops what this application has written, and ``drop`` what
was written between two calls of ``written``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_LOCAL_DEFAULT = "file:///tmp/refloom-scratch"
#: Rows of an Arrow batch where texts go to Python.
BATCH_ROWS = 512
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def root(spark: SparkSession) -> str:
    """The application's scratch folder. Only a local master may run without ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL_DEFAULT
    return f"{base.rstrip('/')}/refloom/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no earlier call has returned."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared scratch and return a frame that reads it back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Whatever is cut inside is read and goes to Python workers ``rows`` rows at a time, so that a batch of texts is small on both sides."""
    before = {key: spark.conf.get(key) for key in _BATCHES}
    for key in before:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(since: int = 0) -> list[str]:
    """Paths of the tables cut so far, after the first ``since``."""
    return _WRITTEN[since:]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no result reads any more."""
    for each in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(each)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results that still read them break."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
