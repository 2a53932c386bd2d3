"""Filters, lookups and top-k reports over rows of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions.text import word_count


def search(rows: DataFrame, query: str = "", terms: Sequence[str] = (), min_words: int = 0, text: str = "text", title: str | None = None, keywords: str | None = None) -> DataFrame:
    """Query in title or text in any case, any of the terms among the keywords, and so many words."""
    if query:
        hit = F.contains(F.lower(F.col(text)), F.lit(query.lower()))
        rows = rows.filter(hit | F.contains(F.lower(F.col(title)), F.lit(query.lower())) if title else hit)
    if terms:
        rows = rows.filter(F.arrays_overlap(F.col(keywords), F.array(*map(F.lit, terms))))
    return rows.filter(word_count(F.col(text)) >= min_words) if min_words else rows


def any_column(rows: DataFrame, needle: str) -> DataFrame:
    """Rows that have the needle in any column, in any case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns))), F.lit(needle.lower())))


def top(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of a total order: a heap per partition, then one of heaps."""
    return rows.orderBy(*order).limit(n)


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in order: a partial aggregation, so large groups are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, "_row.*")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows per group; the rank filter is pushed below the shuffle as a group limit."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def bucketed(value: Column, groups: dict[str, Sequence[str]], other: str = "Other") -> Column:
    """Name of the first group that lists the value."""
    out = None
    for name, members in groups.items():
        out = F.when(value.isin(*members), name) if out is None else out.when(value.isin(*members), name)
    return out.otherwise(other)


# Categories of titles and of coordinates' titles, the first that has one of its words in any case.
TITLE_RULES = (
    ("Defense", ("milorb", "psv", "defense", "weapon", "military")),
    ("Cassini Diskus", ("cassini", "diskus")),
    ("NodeSpaces", ("nodespace", "golay")),
    ("XViS", ("dream", "consciousness", "xvis")),
    ("Contact", ("giselian", "denebian", "probe")),
)
COORDINATE_RULES = (("Entry Event", ("entry event",)), ("PSV Operation", ("sienna", "akrij")))


def title_category(title: Column, rules: Sequence[tuple[str, Sequence[str]]] = TITLE_RULES, other: str = "Other") -> Column:
    """Name of the first rule of which a word occurs in the title, in any case; a null title has none."""
    low, out = F.lower(F.coalesce(title, F.lit(""))), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other) if out is not None else F.lit(other)


def primary_category(labels: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "general") -> Column:
    """Name of the first rule of which the labels have any."""
    out = None
    for name, any_of in rules:
        hit = F.arrays_overlap(labels, F.array(*map(F.lit, any_of)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames the columns that exist and whose new name is free."""
    return rows.withColumnsRenamed({a: b for a, b in names.items() if a in rows.columns and b not in rows.columns})
