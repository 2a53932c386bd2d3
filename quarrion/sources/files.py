"""Readers of the input files, each with a fixed schema. Rows that can't be parsed give nulls, not errors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion import schemas
from quarrion.functions.signal import wav_samples
from quarrion.functions.text import month_from_url, references, tag_terms, word_count
from quarrion.shipping import shipped
from quarrion.sources.pieces import HEAD, pieces
from quarrion.storage import written


def _or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What read gives; where the path doesn't exist, an empty frame."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return schemas.empty(spark, schema)
        raise


#: Columns of the older layouts, by the name they have now.
LEGACY = {"url": ("url", "URL"), "title": ("title", "Title"), "date": ("date", "Date"), "text": ("text", "Excerpt"), "type": ("type", "Category"), "word_count": ("Word Count", "Words"), "position": ("position",)}


def excerpts(spark: SparkSession, path: str, terms: Sequence[str] = ()) -> DataFrame:
    """Excerpts of any layout: id, url, title, date, excerpt, word_count, keywords, refs, type, position.

    The header is read first, so that the columns can be told apart by name; everything is read as text.
    """
    raw = _or_empty(lambda: spark.read.csv(path, header=True, multiLine=True, escape='"'), spark, schemas.EXCERPTS)

    def column(name: str):
        own = [F.col(f"`{c}`") for c in LEGACY[name] if c in raw.columns]
        return F.nullif(F.coalesce(*own), F.lit("")).cast("string") if own else F.lit(None).cast("string")

    text = F.coalesce(column("text"), F.lit(""))
    count = F.coalesce(column("word_count").try_cast("int"), word_count(text))
    return raw.select(
        F.xxhash64(column("url"), text, column("position")).alias("id"), column("url").alias("url"), column("title").alias("title"), F.coalesce(column("date"), month_from_url(column("url"))).alias("date"), text.alias("excerpt"),
        count.alias("word_count"), tag_terms(text, terms).alias("keywords") if terms else F.array().cast("array<string>").alias("keywords"), references(text).alias("refs"), column("type").alias("type"), column("position").try_cast("int").alias("position"),
    )


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, value): the members of the one array or object that each file holds, numbered from 0 within the file.

    One large document is read in as many tasks as it has blocks, and its text isn't moved between them. A member of an object is
    `"name": value`; a member's own text is in one row.
    """
    rows, _ = pieces(spark, path, 1)
    return rows.select("file", "element", "value").filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")


def articles(spark: SparkSession, path: str) -> DataFrame:
    def read() -> DataFrame:
        return json_elements(spark, path).select(F.from_json("value", schemas.ARTICLES).alias("a")).select("a.*")

    rows = _or_empty(read, spark, schemas.ARTICLES)
    return rows.withColumn("month", F.try_to_timestamp(F.concat("date", F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(lambda: spark.read.json(path, schema=schemas.STATISTICS, multiLine=True), spark, schemas.STATISTICS)


def keyword_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings keyword, url, text of an index whose entries are objects or plain urls. Lists may be of any length: each entry is a row."""

    def read() -> DataFrame:
        rows, starts = pieces(spark, path, 2)
        first = F.col("entry") == 0
        own = F.from_json(F.concat(F.lit('["'), F.regexp_extract("value", HEAD, 1), F.lit('"]')), "array<string>")[0]
        named = rows.withColumn("name", F.coalesce("name", F.when(first & F.col("value").rlike(HEAD), own)))
        # Of the lists that blocks start in, one or none a block, the name stands in an earlier one.
        heads = named.filter(first).join(F.broadcast(starts), ["file", "element"], "left_semi").select("file", "element", F.col("name").alias("head"))
        known = named.join(F.broadcast(heads), ["file", "element"], "left").withColumn("keyword", F.coalesce("name", "head")).filter("keyword is not null")
        text = F.when(first, F.regexp_replace("value", HEAD, "")).otherwise(F.col("value"))
        text = F.trim(F.when(F.col("last"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text), F.lit(" \t\r\n"))
        return known.select("keyword", F.col("entry").cast("int").alias("position"), text.alias("value")).filter("value != ''")

    entries = _or_empty(read, spark, "keyword string, position int, value string")
    one = F.from_json("value", "url string, text string")
    plain = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    is_object = F.col("value").startswith("{")
    return entries.select("keyword", F.when(is_object, one["url"]).otherwise(plain).alias("url"), F.when(is_object, one["text"]).alias("text"), "position")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose numbers don't parse are left out."""
    rows = _or_empty(lambda: spark.read.csv(path, header=True, schema=schemas.COORDINATES), spark, schemas.COORDINATES)
    return rows.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")}).filter("lat is not null and lon is not null")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url per line; blank lines and comments are left out."""
    rows = _or_empty(lambda: spark.read.text(path), spark, "value string").select(F.trim("value").alias("url"))
    return rows.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def known_urls(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("url")
    for p in parts[1:]:
        out = out.unionByName(p.select("url"))
    return out.filter("url is not null").distinct()


def archive_urls(spark: SparkSession, base: str, first: str, last: str) -> DataFrame:
    """base/yyyy/MM for each month of a range."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("month"))
    return months.select(F.concat(F.lit(base.rstrip("/") + "/"), F.date_format("month", "yyyy/MM")).alias("url"))


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 16, fetch: int = 5000) -> DataFrame:
    """A database table, read in ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("fetchsize", fetch)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (url, status, html), kept as JSON lines in any store that Spark reads; lines that can't be parsed are left out.

    Folders named `column=value` add their columns.
    """
    rows = _or_empty(lambda: spark.read.schema(schemas.PAGES).json(path), spark, schemas.PAGES)
    return rows.filter("url is not null or status is not null or html is not null")


def crawl(links: DataFrame, starts: Sequence[str], most_pages: int = 10, listed: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(start, url, page): the pages of the walk from each start over `older` links, at most so many. links: url, older.

    Of several older links of a page the least counts. With listed (url, article: what a page lists) and known (article), a walk
    ends at a page after the second that lists nothing new. Links are doubled, so n pages take log2(n) joins, each written, instead of
    a step, or a copy of the plan, for every page.
    """
    spark = links.sparkSession
    reached = spark.createDataFrame([(s, s, 1) for s in starts], "start string, url string, page int")
    jump = written(links.filter("url is not null and older is not null").groupBy("url").agg(F.min("older").alias("to")))
    hop = 1
    while hop < most_pages:
        further = reached.join(jump, "url").select("start", F.col("to").alias("url"), (F.col("page") + hop).alias("page")).filter(F.col("page") <= most_pages)
        reached = written(reached.unionByName(further))
        hop *= 2
        if hop < most_pages:
            jump = written(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("then")), "to").select("url", F.col("then").alias("to")))
    if listed is not None and known is not None:
        fresh = listed.join(known.select("article"), "article", "left_anti").select("url").distinct()
        ends = reached.filter("page > 2").join(fresh, "url", "left_anti").groupBy(F.col("start").alias("_start")).agg(F.min("page").alias("_end"))
        reached = reached.join(ends, F.col("start") == F.col("_start"), "left").filter("_end is null or page <= _end")
    return reached.groupBy("start", "url").agg(F.min("page").alias("page"))


def audio(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples of mono or stereo 16-bit WAV files; stereo is averaged."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return shipped(files).select("path", "content").mapInPandas(wav_samples, "path string, rate int, samples array<float>")
