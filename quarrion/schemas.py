"""Schemas of the input files; a missing optional input reads as an empty frame of its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARTICLES = "url string, title string, date string, labels array<string>, coordinates array<string>, excerpt_count int, author string"
EXCERPTS = "url string, title string, type string, text string, position int"
COORDINATES = "lat string, lon string, type string, date string, title string, raw string"
CITATIONS = "id long, article_id long, citation_text string, citation_hash string, citation_type string, author string, year string, title string, source string, position int"
BIBLIOGRAPHY = "id long, article_id long, entry_text string, entry_hash string, author string, year string, title string, journal string, volume string, pages string, publisher string, url string, doi string, position int"
IMAGES = "id long, article_id long, image_url string, image_hash string, alt_text string, caption string, width int, height int, file_type string, is_header int, is_downloaded int, local_path string, position int"
ENTITIES = "name string, entity_type string, first_seen string, mention_count int"
PAGES = "url string, status int, html string"
STATISTICS = "total_articles int, total_excerpts int, date_range struct<start:string,end:string>, coordinates map<string,int>, top_labels map<string,int>, keyword_counts map<string,int>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
