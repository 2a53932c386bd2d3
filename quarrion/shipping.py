"""Makes the package importable on the executors of a session."""

from __future__ import annotations

import functools
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


@functools.cache
def _archive() -> str:
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='quarrion-')}/quarrion", "zip", ROOT, "quarrion")


def ship(spark: SparkSession) -> None:
    """Sends the package with the session's files, once. What the driver finds by its own path says nothing of executors."""
    name = _archive()
    if not any(f.endswith("/quarrion.zip") for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(name)


def shipped(df: DataFrame) -> DataFrame:
    """df, whose session has the package on its executors: for operators that send Python functions."""
    ship(df.sparkSession)
    return df
