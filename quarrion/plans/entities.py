"""The library's entities over the driver tables, as frames and as DuckDB common table expressions.

Articles are orders, an article's labels the brands and types of its parts, bibliography entries its line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.shipping import ship
from quarrion.storage import dealt, partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc("o_orderdate", "MM")
    url = F.concat(F.lit("http://site/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), month.alias("month"), url.alias("url"), F.col("o_orderpriority").alias("title"))


def by_article(spark: SparkSession, sf_dir: str, df: DataFrame, key: str) -> DataFrame:
    """df dealt by its article as label_sets is, so that a join of the two moves nothing."""
    return dealt(df, tasks(spark, sf_dir), key)


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks label_sets needs."""
    return partitions(table(spark, sf_dir, "lineitem"))


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, months, labels): what articles with labels have, as distinct values. Items and articles are dealt by article once
    and grouped together, so no join of the two, with its sorts, stands in a task."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = partitions(items)
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("both")), n, "p_partkey")
    both = dealt(items, n, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    of = articles(spark, sf_dir).select("article_id", F.struct("month").alias("dated")).filter("article_id is not null")
    rows = both.select(F.col("l_orderkey").alias("article_id"), "both").unionByName(of, allowMissingColumns=True)
    sets = dealt(rows, n, "article_id").groupBy("article_id").agg(F.collect_set("dated").alias("dated"), F.collect_set("both").alias("both"))
    return sets.filter("size(dated) > 0 and size(both) > 0").select("article_id", F.col("dated.month").alias("months"), F.array_distinct(F.flatten("both")).alias("labels"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article, month of it and distinct label, where label_sets has them."""
    rows = label_sets(spark, sf_dir).select("article_id", "labels", F.explode("months").alias("month"))
    return rows.select("article_id", F.explode("labels").alias("label"), "month")


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("author"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("journal"), F.col("p_brand").alias("publisher"))
    both = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("position"), "author", "title", "journal", "publisher", F.year("l_shipdate").alias("year"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic coordinates, one per customer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), ((key * 7919) % 18000 / 100 - 90).alias("lat"), ((key * 104729) % 36000 / 100 - 180).alias("lon"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("title")
    )


def postings(spark: SparkSession, sf_dir: str, words: Column | None = None) -> DataFrame:
    """Keyword, article and month: an article's brands as keywords."""
    own = labels(spark, sf_dir).filter(F.col("label").startswith("Brand"))
    return own.select(F.col("label").alias("keyword"), F.col("article_id").alias("url"), "month")


ARTICLES = """articles as (
    select o_orderkey as article_id, cast(date_trunc('month', o_orderdate) as date) as month,
           'http://site/' || strftime(o_orderdate, '%Y/%m') || '/' || o_orderkey || '.html' as url, o_orderpriority as title
    from orders)"""
LABELS = (
    ARTICLES
    + """, labels as (
    select distinct a.article_id, a.month, x.label
    from (select l_orderkey, unnest([p_brand, p_type]) as label from lineitem join part on l_partkey = p_partkey) x
    join articles a on a.article_id = x.l_orderkey)"""
)
BIBLIOGRAPHY = """bib as (
    select l_orderkey as article_id, l_linenumber as position, s_name as author, p_name as title, p_type as journal, p_brand as publisher, year(l_shipdate) as year
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""
POINTS = """points as (
    select c_custkey as id, (c_custkey * 7919) % 18000 / 100 - 90 as lat, (c_custkey * 104729) % 36000 / 100 - 180 as lon, c_mktsegment as type, c_name as title
    from customer)"""
POSTINGS = LABELS + """, postings as (select label as keyword, article_id as url, month from labels where label like 'Brand%')"""
