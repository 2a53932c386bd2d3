"""Exports. Documents that must be one file are built from an aggregation; tables are written as folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_features(points: DataFrame, properties: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON feature per row, coordinates as [lon, lat]; for tables of any size, as JSON lines."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return points.select(F.to_json(feature).alias("feature"))


def geojson(points: DataFrame, properties: Sequence[str], **options) -> DataFrame:
    """One FeatureCollection for a report's worth of points."""
    all_ = geojson_features(points, properties, **options).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("f"))
    return all_.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("document"))


def bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON document with an array per part and the number of rows of each."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.collect_list(F.struct("*")).alias(name))
        out = one if out is None else out.crossJoin(one)
    meta = F.struct(*(F.size(n).alias(f"total_{n}") for n in parts)).alias("metadata")
    return out.select(F.to_json(F.struct(meta, *parts)).alias("document"))


def csv(rows: DataFrame, path: str) -> bool:
    """Writes a folder of CSV with header; without rows nothing is written and False is returned."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").csv(path, header=True)
    return True


def with_article(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows with their article's url and title in export order."""
    own = articles.select(F.col("article_id"), F.col("url").alias("article_url"), F.col("title").alias("article_title"))
    return rows.join(own, "article_id").orderBy("article_id", "position")


def nested_articles(articles: DataFrame, **parts: DataFrame) -> DataFrame:
    """A JSON document per article with its rows of each part in order of position."""
    out = articles
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c not in ("article_id", "position")]
        own = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias(name))
        out = out.join(own, "article_id", "left")
    return out.select("article_id", F.to_json(F.struct(*articles.columns, *(F.coalesce(n, F.array()).alias(n) for n in parts))).alias("document"))


def code_exports(decoded: DataFrame) -> dict[str, DataFrame]:
    """new, celestial and combined code tables; decoded: code, lat, lon, method, is_celestial, region, title, url."""
    title = F.substring("title", 1, 100).alias("title")
    new = decoded.filter("not is_celestial").select("code", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "method", "region", title, "url")
    celestial = decoded.filter("is_celestial").select("code", F.round("lon", 4).alias("ra_hours"), F.round("lat", 1).alias("dec_degrees"), "method", title, "url")
    return {"new": new, "celestial": celestial, "combined": new.unionByName(celestial.select("code", "method", "title", "url"), allowMissingColumns=True)}


def download_script(urls: DataFrame, column: str = "image_url", most: int = 100, shell: str = "bash") -> DataFrame:
    """A script that fetches the first urls."""
    first = urls.select(column).distinct().orderBy(column).limit(most)
    name = F.regexp_extract(column, r"([^/]+)$", 1)
    quote = r"'\''" if shell == "bash" else "''"
    name, url = (F.replace(c, F.lit("'"), F.lit(quote)) for c in (name, F.col(column)))
    line = F.format_string("curl -L -o '%s' '%s'", name, url) if shell == "bash" else F.format_string("Invoke-WebRequest -Uri '%s' -OutFile '%s'", url, name)
    return first.select(line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("script"))


def network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return bundle({"nodes": nodes, "edges": edges})


def saved(rows: DataFrame, path: str) -> DataFrame:
    """Writes an expensive result and reads it back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
