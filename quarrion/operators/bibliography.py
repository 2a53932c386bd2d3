"""Statistics of bibliography entries: article_id, position, author, title, journal, publisher, year, entry_text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators.cooccurrence import pair_counts
from quarrion.operators.numbering import numbered
from quarrion.operators.search import top_per_group

# Patterns that mark noise, any case.
NOISE = (r"[a-z]{4,}ff\b", r"\bdys\b", r"\byr\b", r"\beid\b", r"\baeg\b", r"\begel\b", r"\bsid\b", r"\bmer\b", r"\bidalbitau\b", r"\bimass\b", r"\bcynegy\b")

#: Order of exported entries; what has the same place goes by its contents.
ORDER = ["article_id", "position", "author", "title", "journal", "year"]


def noise_reason(author: Column, entry: Column, patterns: Sequence[str] = NOISE) -> Column:
    """Why an entry is noise, the first of four reasons; null if it isn't."""
    author, entry = F.coalesce(author, F.lit("")), F.coalesce(entry, F.lit(""))

    def hits(text: Column) -> Column:
        out = F.lit(0)
        for p in patterns:
            out = out + text.rlike("(?i)" + p).cast("int")
        return out

    return (
        F.when(F.length(author) > 50, "author_too_long")
        .when(hits(entry) >= 3, "fl_language_patterns")
        .when(hits(author) >= 2, "fl_author_patterns")
        .when((F.length(entry) > 500) & ~entry.rlike(r"[.():;]"), "unstructured_long_text")
    )


def named(entries: DataFrame, column: str) -> DataFrame:
    """Rows in which the column is neither null nor empty."""
    return entries.filter(F.coalesce(F.trim(column), F.lit("")) != "")


def author_stats(entries: DataFrame, titles: int = 3, cut: int = 60) -> DataFrame:
    """Entries, articles, years and the first titles of each author.

    Only the first so many titles are kept while rows are merged, so an author with very many entries stays small.
    """
    rows = named(entries, "author")
    per = rows.groupBy("author").agg(F.count("*").alias("entries"), F.countDistinct("article_id").alias("articles"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    each = rows.filter("title is not null").groupBy("author", F.substring("title", 1, cut).alias("t")).agg(F.min(F.struct("article_id", "position")).alias("at"))
    first = top_per_group(each, ["author"], [F.col("at"), F.col("t")], titles).groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "; ").alias("samples"))
    years = F.when(F.col("first_year").isNotNull(), F.concat_ws("-", F.col("first_year").cast("string"), F.col("last_year").cast("string")))
    return per.join(first, "author", "left").select("author", "entries", "articles", years.alias("years"), "samples")


def field_of(text: Column, fields: dict[str, Sequence[str]], other: str = "Other") -> Column:
    """The field with most of its keywords in the text; of equals the one declared first."""
    low = F.lower(text)
    scored = F.array(*(F.struct(sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)).alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(fields.items())))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["name"]).otherwise(other)


def cocitation(entries: DataFrame, top_authors: int = 50, most: int = 50, least: int = 2) -> DataFrame:
    """Pairs of the most cited authors in the same article."""
    rows = named(entries, "author").select("article_id", "author")
    top = rows.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(top_authors).select("author")
    pairs = pair_counts(rows.join(F.broadcast(top), "author"), "article_id", "author", min_count=least)
    return pairs.orderBy(F.desc("weight"), "a", "b").limit(most)


def most_cited(entries: DataFrame, most: int = 20) -> DataFrame:
    """Works by "author (year)": articles, entries and the first title."""
    rows = named(entries, "author").filter("year is not null").withColumn("work", F.concat("author", F.lit(" ("), F.col("year").cast("int").cast("string"), F.lit(")")))
    per = rows.groupBy("work").agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("entries"), F.min_by("title", F.struct("article_id", "position")).alias("title"))
    return per.orderBy(F.desc("articles"), F.desc("entries"), "work").limit(most)


def shares(rows: DataFrame, key: str, places: int = 1) -> DataFrame:
    """Count per key and its percentage of all rows; the window runs over the counts."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per.select(key, "n", F.round(100 * F.col("n") / F.expr("sum(n) over ()"), places).alias("percent"))


def bibtex(entries: DataFrame) -> DataFrame:
    """One BibTeX entry per row; the key is the first word of the author, the year and the row's number."""
    rows = numbered(entries, ORDER)
    name = F.regexp_replace(F.element_at(F.split(F.element_at(F.split("author", ","), 1), " "), 1), "[^A-Za-z0-9#]", "")
    key = F.concat(name, F.col("year").cast("string"), F.lit("_"), F.col("n").cast("string"))
    return rows.select("n", F.format_string("@article{%s,\n  author = {%s},\n  title = {%s},\n  journal = {%s},\n  year = {%s}\n}", key, "author", "title", "journal", F.col("year").cast("string")).alias("entry"))


def ris(entries: DataFrame) -> DataFrame:
    """One RIS record per row, numbered in the same order."""
    rows = numbered(entries, ORDER)
    return rows.select("n", F.format_string("TY  - JOUR\nAU  - %s\nTI  - %s\nJO  - %s\nPY  - %s\nER  - ", "author", "title", "journal", F.col("year").cast("string")).alias("entry"))
