"""Coded coordinates of a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions.decode import codes_in

TITLE = "title"


def scanned(articles: DataFrame, excerpts: DataFrame, most: int = 200) -> DataFrame:
    """(code, url, context): the codes in the titles of articles (url, title) and in excerpts (url, text), each once per url.

    The context is the word title, or the first characters of the excerpt, of several the first in order; titles come first. The first
    place of a code is a partial aggregation, so a url with very many excerpts is reduced before the shuffle.
    """
    titles = articles.select("url", F.explode(codes_in(F.col("title"))).alias("c")).select("url", "c.code", F.lit(0).alias("kind"), F.lit(TITLE).alias("context"))
    told = excerpts.select("url", F.substring("text", 1, most).alias("context"), F.explode(codes_in(F.col("text"))).alias("c")).select("url", "c.code", F.lit(1).alias("kind"), "context")
    both = titles.unionByName(told).groupBy("code", "url").agg(F.min(F.struct("kind", "context")).alias("at"))
    return both.select("code", "url", "at.context")
