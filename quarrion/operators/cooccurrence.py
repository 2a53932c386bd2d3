"""Pairs of items that occur in the same group.

The cost follows the squared number of items in a group; max_items and max_groups drop groups or items above a bound, as the
operators that need it ask for. Counts are made from a row per group with its items, so a group's distinct items, not its pairs,
should fit into a task's memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.operators.search import top_per_group


def pairs(df: DataFrame, group: str, item: str, also: Sequence[str] = ()) -> DataFrame:
    """(group, also..., a, b) with a < b for each two items of a group; df has distinct (group, item)."""
    left = df.select(group, *also, F.col(item).alias("a"))
    right = df.select(F.col(group).alias("_g"), F.col(item).alias("b"))
    return left.join(right, (F.col(group) == F.col("_g")) & (F.col("a") < F.col("b"))).drop("_g")


def set_pair_counts(sets: DataFrame, items: str, min_count: int = 1) -> DataFrame:
    """(a, b, weight) from a row per group with the array of its distinct items. Pairs are made one by one and summed before the shuffle."""
    each = sets.select(F.array_sort(F.array_compact(items)).alias("s")).select("s", F.posexplode("s").alias("i", "a"))
    each = each.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return each.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_count)


def pair_counts(df: DataFrame, group: str, item: str, max_groups: int | None = None, min_count: int = 1) -> DataFrame:
    """(a, b, weight); items in more than max_groups groups are left out."""
    rows = df.select(group, item).filter(F.col(group).isNotNull())
    if max_groups:
        rows = rows.distinct()
        rows = rows.join(rows.groupBy(item).count().filter(F.col("count") <= max_groups).select(item), item)
    return set_pair_counts(rows.groupBy(group).agg(F.collect_set(item).alias("_items")), "_items", min_count)


def keyword_nodes(postings: DataFrame, item: str = "url", key: str = "keyword", most: int = 5) -> DataFrame:
    """Per item the number of its keywords and the first of them by how many items share them, ties by name."""
    rows = postings.select(item, key).distinct()
    shared = rows.groupBy(key).agg(F.count("*").alias("n"))
    best = top_per_group(rows.join(shared, key), [item], [F.desc("n"), F.col(key)], most)
    named = best.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("k"))
    counts = rows.groupBy(item).agg(F.count("*").alias("keyword_count"))
    return counts.join(named, item).select(item, "keyword_count", F.transform("k", lambda x: x[key]).alias("top_keywords"))
