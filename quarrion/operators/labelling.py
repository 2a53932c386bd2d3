"""Classes, families and life cycles of labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.operators.cooccurrence import pairs
from quarrion.operators.search import top_per_group
from quarrion.shipping import shipped

# Shapes of a coined label, one point each, and words that speak for a topic.
SHAPES = (r"^[A-Z][a-z]{2,8}$", r" aff ", r" dys ", r" dy ", r" yr ", r" ud ", r" aeg ", r"'s ")
TOPIC_WORDS = ("language", "languages", "god", "goddess", "old", "cities", "future", "south", "north", "east", "west", "central", "proto", "pre")


def classified(labels: DataFrame, topics: Sequence[str], languages: Sequence[str], shapes: Sequence[str] = SHAPES) -> DataFrame:
    """Class topic, language or ambiguous of each label, with articles and confidence.

    Listed labels are certain (0.95). Others get points from the labels they occur with, their shape and their count.
    labels has distinct (article_id, label).
    """
    is_topic, is_language = F.col("other").isin(*topics), F.col("other").isin(*languages)
    both = pairs(labels, "article_id", "label")
    near = both.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other")), F.struct(F.col("b").alias("label"), F.col("a").alias("other")))).alias("n")).select("n.*")
    co = near.groupBy("label").agg(F.count("*").alias("co"), F.sum(is_topic.cast("int")).alias("t"), F.sum(is_language.cast("int")).alias("l"))
    rows = labels.groupBy("label").agg(F.count("*").alias("article_count")).join(co, "label", "left").na.fill(0)
    label = F.col("label")
    foreign = label.rlike(r"[^\x00-\x7F]")
    by_topic, by_language = (F.coalesce(F.try_divide(F.col(c), F.col("co")), F.lit(0.0)) > 0.6 for c in ("t", "l"))
    shape = F.lit(0)
    for p in shapes:
        shape = shape + label.rlike(p).cast("int")
    first = F.when(by_topic, 2).otherwise(0) + F.when(foreign, 2).otherwise(0) + shape
    topic = F.when(~by_topic & by_language, 2).otherwise(0) + F.arrays_overlap(F.split(F.lower(label), " "), F.array(*map(F.lit, TOPIC_WORDS))).cast("int")
    rows = rows.withColumn("first", first).withColumn("topic", topic)
    many = (F.col("article_count") >= 30) & (F.col("first") >= F.col("topic"))
    rows = rows.withColumn("lang", F.col("first") + many.cast("int")).withColumn("base", 0.5 + F.when(foreign, 0.1).otherwise(0.0) + F.when(many, 0.1).otherwise(0.0))
    gap = F.col("lang") - F.col("topic")
    kind = F.when(label.isin(*topics), "topic").when(label.isin(*languages), "language").when(gap > 0, "language").when(gap < 0, "topic").otherwise("ambiguous")
    sure = F.when(label.isin(*topics, *languages), 0.95).when(gap == 0, F.col("base")).otherwise(F.least(F.lit(0.9), F.col("base") + 0.1 * F.abs(gap)))
    return rows.select("label", kind.alias("classification"), "article_count", F.round(sure, 2).alias("confidence"))


def lifecycle(dated: DataFrame, key: str = "label", active_months: int = 18, dormant_months: int = 36) -> DataFrame:
    """Birth, last month, lifespan, peak month (the first of equals) and status of each label."""
    per = dated.groupBy(key, "month").agg(F.count("*").alias("n"))
    end = per.agg(F.max("month").alias("end"))
    life = per.groupBy(key).agg(F.min("month").alias("birth"), F.max("month").alias("last"), F.sum("n").alias("total"), F.max_by("month", F.struct("n", -F.unix_date("month"))).alias("peak"))
    span = F.months_between("last", "birth").cast("int") + 1
    status = F.when(F.col("last") >= F.add_months("end", -active_months), "active").when(F.col("last") >= F.add_months("end", -dormant_months), "dormant").otherwise("retired")
    return life.crossJoin(F.broadcast(end)).select(key, "birth", "last", "total", span.alias("lifespan_months"), "peak", status.alias("status"))


def families(matrix: DataFrame, key: str, item: str, weight: str, threshold: float = 0.6, least: int = 5) -> DataFrame:
    """Families of keys with like item weights: each key in order of its total joins the first family whose centroid is
    as near as the threshold by cosine, else founds one.

    The order matters, so this is one task; it holds one row per key, and the matrix is of labels, not of articles.
    """
    heavy = matrix.groupBy(key).agg(F.sum(weight).alias("total")).filter(F.col("total") >= least)
    rows = matrix.join(heavy, key).groupBy(key).agg(F.max("total").alias("total"), F.collect_list(F.col(item).cast("string")).alias("items"), F.collect_list(F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("weights"))
    kind = matrix.schema[key].dataType.simpleString()

    def grouped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(parts)
        if not sum(map(len, own)):
            return
        df = pd.concat(own, ignore_index=True)
        df = df.sort_values(["total", key], ascending=[False, True])
        items = sorted({i for own in df["items"] for i in own})
        at = {x: i for i, x in enumerate(items)}
        sums, sizes, out = [], [], []
        for name, own, weights in zip(df[key], df["items"], df["weights"], strict=True):
            v = np.zeros(len(items))
            v[[at[i] for i in own]] = weights
            likes = [float(v @ s / (np.linalg.norm(v) * np.linalg.norm(s) or 1)) for s in sums]
            best = int(np.argmax(likes)) if likes and max(likes) >= threshold else len(sums)
            if best == len(sums):
                sums.append(np.zeros(len(items)))
                sizes.append(0)
            sums[best] += v
            sizes[best] += 1
            out.append((name, best))
        yield pd.DataFrame(out, columns=[key, "family"])

    return shipped(rows).coalesce(1).mapInPandas(grouped, f"{key} {kind}, family int")


def family_summary(members: DataFrame, matrix: DataFrame, articles: DataFrame, key: str, item: str, weight: str, listed: int = 10, topics: int = 3) -> DataFrame:
    """Per family its size, its first members by name, its heaviest items with their sums, and its members' articles.

    members: key, family. articles: key, article_count.
    """
    per = members.join(articles, key, "left").groupBy("family")
    sizes = per.agg(F.count("*").alias("n_members"), F.coalesce(F.sum("article_count"), F.lit(0)).alias("article_count"))
    names = top_per_group(members, ["family"], [F.col(key)], listed).groupBy("family").agg(F.array_sort(F.collect_list(key)).alias("members"))
    sums = matrix.join(members, key).groupBy("family", item).agg(F.sum(weight).alias("n")).filter("n > 0")
    best = top_per_group(sums, ["family"], [F.desc("n"), F.col(item)], topics).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rank", item, "n"))).alias("t"))
    told = F.array_join(F.transform("t", lambda x: F.concat(x[item], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    rows = sizes.join(names, "family").join(best.select("family", told.alias("primary_topics")), "family", "left")
    more = F.when(F.col("n_members") > listed, F.concat(F.lit(" (+"), (F.col("n_members") - listed).cast("string"), F.lit(" more)"))).otherwise("")
    return rows.select("family", F.concat(F.array_join("members", ", "), more).alias("members"), "n_members", F.coalesce("primary_topics", F.lit("")).alias("primary_topics"), "article_count")
