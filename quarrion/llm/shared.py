"""What the training-data operators share: inputs, the shared folder, and materialised tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.shipping import shipped
from quarrion.storage import conf, discard, shared_folder, written

__all__ = ["ascii_lower", "conf", "crc_mod5", "discard", "doc_text", "kind_of", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def doc_text(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, for the schemas of functions over Arrow batches."""
    return df.select(column).schema[0].dataType.simpleString()


def crc_mod5(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
