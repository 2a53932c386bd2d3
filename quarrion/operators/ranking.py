"""Importance scores, reading lists and vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions.text import cosine
from quarrion.operators.numbering import numbered
from quarrion.storage import dealt


def term_score(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms that the text has, in any case."""
    low, out = F.lower(text), F.lit(0.0)
    for term, w in weights.items():
        out = out + F.when(F.contains(low, F.lit(term.lower())), w).otherwise(0.0)
    return out


def importance(articles: DataFrame, labels: DataFrame, excerpts: DataFrame, label_weights: dict[str, float], term_weights: dict[str, float], per_excerpt: float = 0.5, most_excerpts: float = 10.0, coordinates: float = 15.0, tasks: int | None = None) -> DataFrame:
    """Score per url: labels, terms in each excerpt, the number of excerpts up to a limit, and whether it has coordinates.

    articles: url, has_coordinates; labels: url, label, or a row per url with the array of its labels; excerpts: url, text.
    With tasks, articles and the scores of excerpts are dealt by url to so many, as labels should be.
    """
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, w in label_weights.items() for x in (k, float(w)))), F.col("label")), F.lit(0.0))
    if "labels" in labels.columns:
        of = F.map_from_arrays(F.array(*map(F.lit, label_weights)), F.array(*(F.lit(float(w)) for w in label_weights.values())))
        by_label = labels.select("url", F.aggregate("labels", F.lit(0.0), lambda a, x: a + F.coalesce(of[x], F.lit(0.0))).alias("l"))
    else:
        by_label = labels.select("url", F.when(F.col("label").isin(*label_weights), weight).otherwise(0.0).alias("w")).groupBy("url").agg(F.sum("w").alias("l"))
    told = excerpts.select("url", term_score(F.col("text"), term_weights).alias("t"))
    if tasks:
        articles, told = dealt(articles, tasks, "url"), dealt(told, tasks, "url")
    by_text = told.groupBy("url").agg(F.sum("t").alias("t"), F.least(F.count("*") * per_excerpt, F.lit(most_excerpts)).alias("e"))
    both = articles.join(by_label, "url", "left").join(by_text, "url", "left").na.fill(0, ["l", "t", "e"])
    return both.select("url", (F.col("l") + F.col("t") + F.col("e") + F.when(F.col("has_coordinates"), coordinates).otherwise(0.0)).alias("score"))


def reading_order(rows: DataFrame, score: str = "score", key: str = "url", easy: float = 0.2, middle: float = 0.6) -> DataFrame:
    """Order by falling score with a tier by the rank's share. rows is a list of bounded length, as reading lists are."""
    w = Window.orderBy(F.desc(score), key)
    rank, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(F.lit(1)))
    tier = F.when(rank < easy * n, "beginner").when(rank < middle * n, "intermediate").otherwise("advanced")
    return rows.withColumn("reading_order", rank + 1).withColumn("difficulty", tier)


def topic_terms(topic: str, categories: dict[str, Sequence[str]]) -> list[str]:
    """The words of the categories in whose name the topic occurs, or of which a word occurs in the topic; else the topic itself."""
    low = topic.lower()
    found = [w for name, words in categories.items() if low in name or any(w.lower() in low for w in words) for w in words]
    return list(dict.fromkeys(found)) or [topic]


def topic_reading_list(topic: str, categories: dict[str, Sequence[str]], postings: DataFrame, excerpts: DataFrame, scores: DataFrame, most: int = 20, difficulty: str | None = None, easy: float = 0.2, middle: float = 0.6, tasks: int | None = None) -> DataFrame:
    """The first rows of a topic's reading list: url, matched (the word that led to it), score, reading_order, difficulty.

    postings: keyword, url; excerpts: url, text; scores: url, score of every article. An article is found by the first of the
    topic's words that lists it, else by the first that occurs in its excerpts. The list goes by falling score, then by url; its
    places come from ranges, so a topic may hold any number of articles. With a difficulty, only its rows are listed. With tasks, hits
    are dealt by url to so many, as scores should be, and places come from as many ranges.
    """
    terms = topic_terms(topic, categories)
    order = F.create_map(*(F.lit(x) for k, w in enumerate(terms) for x in (w, k)))
    listed = postings.filter(F.col("keyword").isin(terms)).select("url", F.col("keyword").alias("matched"), order[F.col("keyword")].alias("ord"))
    low = F.lower("text")
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w.lower())), F.struct(F.lit(k).alias("ord"), F.lit(w).alias("matched"))) for k, w in enumerate(terms))))
    told = excerpts.select("url", F.get(hits, F.lit(0)).alias("hit")).filter("hit is not null").select("url", "hit.matched", "hit.ord")
    found = hits_by_priority(listed, told, tasks=tasks).join(scores.select("url", "score"), "url").select("url", "matched", F.coalesce("score", F.lit(0.0)).alias("score"))
    placed = numbered(found, [F.desc("score"), F.col("url")], "reading_order", tasks)
    n = placed.agg(F.count("*").alias("_n"))
    at = F.col("reading_order") - 1
    tier = F.when(at < easy * F.col("_n"), "beginner").when(at < middle * F.col("_n"), "intermediate").otherwise("advanced")
    rows = placed.crossJoin(F.broadcast(n)).withColumn("difficulty", tier).drop("_n")
    rows = rows.filter(F.col("difficulty") == difficulty) if difficulty else rows
    return rows.orderBy("reading_order").limit(most)


def diverse(rows: DataFrame, category: str, score: str = "score", key: str = "url", least: float = 10, free: int = 5, most: int = 20) -> DataFrame:
    """The best rows above a score: the first few whatever their category, then only the best of each further category.

    The overall rank is needed for the first few only, so it comes from a top-k, not from a window over all rows.
    """
    good = rows.filter(F.col(score) > least)
    head = good.orderBy(F.desc(score), key).limit(free)
    best = good.groupBy(category).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("m")).select(F.col("m.k").alias(key))
    picked = head.select(key).unionByName(best).distinct()
    return good.join(picked, key, "left_semi").orderBy(F.desc(score), key).limit(most)


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows of greatest cosine with the query: one pass, a heap per partition."""
    like = cosine(F.col(column), F.array(*(F.lit(float(x)) for x in query)).cast("array<double>"))
    return vectors.select(key, like.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def mean_vectors(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Mean vector per group, by place, so partial sums are made before the shuffle."""
    each = vectors.select(group, F.posexplode(column).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))


def similar_groups(vectors: DataFrame, group: str, value, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Other groups by the greatest cosine of any of their rows with the mean of one group."""
    mean = mean_vectors(vectors.filter(F.col(group) == value), group, column).select("mean")
    rows = vectors.filter(F.col(group) != value).crossJoin(F.broadcast(mean)).select(group, key, cosine(F.col(column), F.col("mean")).alias("similarity"))
    return rows.groupBy(group).agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), group).limit(k)


def hits_by_priority(keyword_hits: DataFrame, text_hits: DataFrame, key: str = "url", tasks: int | None = None) -> DataFrame:
    """One row per key: keyword hits come before text hits, then the order of the terms. Both have key, matched, ord."""
    both = keyword_hits.withColumn("kind", F.lit(0)).unionByName(text_hits.withColumn("kind", F.lit(1)))
    both = dealt(both, tasks, key) if tasks else both
    return both.groupBy(key).agg(F.min(F.struct("kind", "ord", "matched")).alias("m")).select(key, "m.matched")
