"""Places of rows in an order over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.storage import written

_AT, _RANGE, _BEFORE = "__at", "__range", "__before"
#: Spark's row ids hold the task above these bits and the place within the task below.
_BITS = 33


def _ranged(df: DataFrame, order: list[Column | str], ranges: int | None = None) -> DataFrame:
    """df written in ranges of the order, each sorted, with the place of each row: its range above _BITS, and the row below."""
    return written((df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id()))


def _own(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def numbered(df: DataFrame, order: list[Column | str], name: str = "n", ranges: int | None = None) -> DataFrame:
    """df with a column of places 1, 2, 3... in the order, as row_number() over an unpartitioned window gives.

    Rows are range-partitioned by the order, sorted within their ranges and written; a range's rows are then numbered from
    the number of rows in the ranges before it. Only the counts, one per range, meet in one task. Rows that are equal in the
    order share a range, so the order should end in a key; between them, any row may come first. An empty table gives none. ranges: how many, else the session's partitions.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    held = _ranged(df, order, ranges)
    task = F.shiftright(_AT, _BITS)
    counts = held.groupBy(task.alias(_RANGE)).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(_RANGE, F.coalesce(before, F.lit(0)).alias(_BEFORE))
    place = F.col(_BEFORE) + F.col(_AT).bitwiseAND((1 << _BITS) - 1) + 1
    return held.join(F.broadcast(offsets), task == F.col(_RANGE)).select(*_own(df), place.alias(name))


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with the sums of columns up to and with each row in the order, under new names; null counts as 0.

    A range's sums run within it, from the sums of the ranges before; one row per range meets in one task. As with numbered, the
    order should end in a key: between equal rows any may come first.
    """
    held = _ranged(df, order).withColumn(_RANGE, F.shiftright(_AT, _BITS))
    values = {name: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for name, c in sums.items()}
    totals = held.groupBy(_RANGE).agg(*(F.sum(v).alias(name) for name, v in values.items()))
    earlier = Window.orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumnRenamed(_RANGE, "before").select("before", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{_BEFORE}_{name}") for name in values))
    within = Window.partitionBy(_RANGE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.select(*_own(df), _RANGE, *(F.sum(v).over(within).alias(f"{_AT}_{name}") for name, v in values.items()))
    return local.join(F.broadcast(offsets), F.col(_RANGE) == F.col("before")).select(*_own(df), *((F.col(f"{_AT}_{name}") + F.col(f"{_BEFORE}_{name}")).alias(name) for name in values))
