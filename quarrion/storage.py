"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows that a task sorts or joins at once, about.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names; a temporary one only where executors run inside the driver (tests)."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quarrion-")


@contextmanager
def conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while a job of ours starts and runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(df: DataFrame) -> int:
    """As many partitions as give each TASK_ROWS rows. For tables as they are read: their files' footers hold the count."""
    return -(-df.count() // TASK_ROWS)


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df in n partitions by its keys, or as many as keep the session's cores busy. Whatever the session's own number of partitions,
    they are named ones, which Spark doesn't merge, so that a task's rows don't grow with the table."""
    spark = df.sparkSession
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(n, cores), *keys)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. Its shuffles' files go at once."""
    path = shared_folder(df.sparkSession)
    with conf(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
