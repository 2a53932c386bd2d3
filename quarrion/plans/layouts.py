"""Queries over the file layouts: the given tables are written as such files and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrion.functions import extract as X
from quarrion.functions import text as C
from quarrion.operators import codes
from quarrion.plans import entities as E
from quarrion.plans import spatial
from quarrion.plans.registry import Registry
from quarrion.sources import files, sinks
from quarrion.storage import shared_folder

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
#: Tasks that documents are dealt to.
TASKS = 200


def _documents(rows, key: str, order: str, start, one, end) -> str:
    """A folder with a document per key, made of its rows in order: each row is a line of the file, so that none is held whole."""
    of = Window.partitionBy(key).orderBy(order)
    placed = rows.repartition(TASKS, key).withColumns({"_n": F.row_number().over(of), "_more": F.lead(F.lit(1)).over(of)})
    line = F.concat(F.when(F.col("_n") == 1, start).otherwise(""), one, F.when(F.col("_more").isNull(), end).otherwise(","))
    path = shared_folder(rows.sparkSession)
    placed.select(key, order, line.alias("value")).sortWithinPartitions(key, order).select(key, "value").write.partitionBy(key).text(path)
    return path


@query(
    f"""with {E.ARTICLES}, l as (select l_orderkey, list(l_linenumber::varchar order by l_linenumber, l_partkey) as labels from lineitem group by 1)
    select url, title, month, coalesce(len(labels), 0) as labels, article_id::int as excerpt_count from articles left join l on l_orderkey = article_id""",
    dates="month",
)
def article_files(spark, sf_dir):
    """Articles as one JSON array a month, with commas, quotes and brackets in their titles, read in pieces."""
    items = E.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string")).alias("labels"))
    rows = E.articles(spark, sf_dir).join(items, "article_id", "left")
    rows = rows.withColumn("m", F.date_format("month", "yyyy-MM"))
    one = F.to_json(F.struct("url", F.concat("title", F.lit(' "[x, {y}"')).alias("title"), F.col("m").alias("date"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.col("article_id").cast("int").alias("excerpt_count")))
    path = _documents(rows, "m", "article_id", F.lit("[ "), one, F.lit("]"))
    return files.articles(spark, path).select("url", F.regexp_replace("title", r' "\[x, \{y\}"$', "").alias("title"), "month", F.size("labels").cast("long").alias("labels"), "excerpt_count")


@query(f"with {E.POSTINGS}, r as (select keyword, url, row_number() over (partition by keyword order by url) - 1 as position from postings) select keyword, 'u' || url as url, case when url % 2 = 0 then keyword || ', \"' || url || '\"' end as text, position::int as position from r")
def keyword_index_files(spark, sf_dir):
    """Postings as one JSON object a keyword, of entries that are objects or plain urls, read in pieces."""
    posted = E.postings(spark, sf_dir).select("keyword", "url")
    url = F.concat(F.lit("u"), "url")
    entry = F.when(F.col("url") % 2 == 0, F.to_json(F.struct(url.alias("url"), F.concat("keyword", F.lit(', "'), F.col("url").cast("string"), F.lit('"')).alias("text")))).otherwise(F.concat(F.lit('"'), url, F.lit('"')))
    path = _documents(posted, "keyword", "url", F.concat(F.lit('{"'), "keyword", F.lit('": [')), entry, F.lit("]}"))
    return files.keyword_index(spark, path)


@query(f"""with {E.ARTICLES} select url, title, strftime(month, '%Y-%m') as date, 'He said "' || title || ', FL-' || lpad((article_id % 1000000)::varchar, 6, '0') || '"' as excerpt, 3 + len(string_split_regex(title, '\\s+')) as word_count, 'URGENT' as keywords from articles where title = '1-URGENT'""")
def excerpt_files(spark, sf_dir):
    """Excerpts in the older layout, with quotes and commas: dates from urls, words counted, terms tagged."""
    rows = E.articles(spark, sf_dir).filter("title = '1-URGENT'")
    code = F.concat(F.lit("FL-"), F.lpad((F.col("article_id") % 1_000_000).cast("string"), 6, "0"))
    text = F.concat(F.lit('He said "'), "title", F.lit(", "), code, F.lit('"'))
    path = shared_folder(spark)
    rows.select(F.col("url").alias("URL"), F.col("title").alias("Title"), text.alias("Excerpt"), F.lit("x").alias("Category")).write.csv(path, header=True, escape='"')
    return files.excerpts(spark, path, ("URGENT", "none")).select("url", "title", "date", "excerpt", F.col("word_count").cast("long").alias("word_count"), F.array_join("keywords", ",").alias("keywords"))


@query(f"with {E.POINTS} select title, lat::double as lat, lon::double as lon from points where id % 7 > 0", rounded="lat lon")
def coordinate_files(spark, sf_dir):
    """Coordinates with rows whose numbers don't parse."""
    points = E.points(spark, sf_dir)
    number = F.when(F.col("id") % 7 > 0, F.col("lat").cast("string")).otherwise("36N")
    path = shared_folder(spark)
    points.select(number.alias("lat"), F.col("lon").cast("string").alias("lon"), F.lit("gps").alias("type"), F.lit("").alias("date"), "title", F.lit("").alias("raw")).write.csv(path, header=True)
    return files.coordinates(spark, path).select("title", "lat", "lon")


@query(f"with {E.ARTICLES} select strftime(month, '%Y') as year, count(*)::int as total_articles, min(strftime(month, '%Y-%m')) as first, count(*) filter (where title = '5-LOW')::int as low from articles group by 1")
def statistics_files(spark, sf_dir):
    """Statistics of each year as a JSON document, with a map of title counts."""
    rows = E.articles(spark, sf_dir).withColumn("year", F.date_format("month", "yyyy"))
    titles = rows.groupBy("year", "title").agg(F.count("*").alias("n")).groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("title", "n"))).alias("top_labels"))
    month = F.date_format("month", "yyyy-MM")
    per = rows.groupBy("year").agg(F.count("*").alias("total_articles"), F.struct(F.min(month).alias("start"), F.max(month).alias("end")).alias("date_range")).join(titles, "year")
    path = shared_folder(spark)
    per.repartition("year").write.partitionBy("year").json(path)
    found = files.statistics(spark, path)
    return found.select(F.substring("date_range.start", 1, 4).alias("year"), "total_articles", F.col("date_range.start").alias("first"), C.value_of(F.col("top_labels"), "5-LOW").alias("low"))


@query("select page_id % 5 as part, url, case when page_id % 9 = 0 then 404 else 200 end as status, md5(html) as digest from pages")
def stored_pages(spark, sf_dir):
    """Pages with their status as JSON lines, with lines between them that aren't JSON."""
    rows = E.table(spark, sf_dir, "pages")
    path = shared_folder(spark)
    one = F.to_json(F.struct("url", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200).alias("status"), "html"))
    rows.select(F.explode(F.array(one, F.lit("{not json"))).alias("value"), (F.col("page_id") % 5).alias("part")).write.partitionBy("part").text(path)
    return files.stored_pages(spark, path).select(F.col("part").cast("long").alias("part"), "url", "status", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("select distinct 'http://site/' || c_custkey as url from customer where c_custkey % 5 > 0")
def url_list_files(spark, sf_dir):
    """A list of urls with comments, blanks and repeated lines."""
    key = F.col("c_custkey")
    line = F.when(key % 5 > 0, F.concat(F.lit("  http://site/"), key.cast("string"), F.lit(" "))).when(key % 2 == 0, F.lit("# comment")).otherwise("  ")
    path = shared_folder(spark)
    customers = E.table(spark, sf_dir, "customer").select(line.alias("value"))
    customers.unionByName(customers).write.text(path)
    return files.url_list(spark, path).distinct()


@query(
    """with recursive l as (select c_custkey as k, c_custkey + 3 as older from customer where c_custkey + 3 in (select c_custkey from customer)),
    walk(start, k, page) as (select c_custkey, c_custkey, 1 from customer where c_custkey in (1, 50) union all select start, older, page + 1 from walk join l using (k) where page < 40 and (page <= 2 or k % 20 > 0))
    select 'p' || start as start, 'p' || k as url, page from walk"""
)
def crawled_pages(spark, sf_dir):
    """Archive pages from two starts, until a page lists nothing new."""
    keys = E.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    links = keys.join(keys.select((F.col("k") - 3).alias("k"), F.lit(1).alias("there")), "k").select(name(F.col("k")).alias("url"), name(F.col("k") + 3).alias("older"))
    listed = keys.select(name(F.col("k")).alias("url"), (F.col("k") % 20).alias("article"))
    return files.crawl(links, ["p1", "p50"], 40, listed, keys.select(F.lit(0).cast("long").alias("article")).distinct())


@query("select p_partkey, p_name as title, strftime(date '2010-01-01' + (p_partkey % 300)::int, '%B %-d, %Y') as date from part")
def markdown_pages(spark, sf_dir):
    """Title and date of pages in markdown."""
    day = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "MMMM d, yyyy")
    text = F.concat(F.lit("# Site\n## "), day, F.lit("\n### ["), "p_name", F.lit("](http://site/x)\nbody ### [no]"))
    return E.table(spark, sf_dir, "part").select("p_partkey", X.markdown_meta(text).alias("m")).select("p_partkey", "m.title", "m.date")


@query(f"""with {E.POINTS}, t as (select id, lat, lon, format('{{:.3f}}, {{:.3f}}', lat, lon) as gps, (id % 90)::varchar || '°' || (id % 60)::varchar || '''N' as dms from points)
    select id, list_sort([gps, dms]) as mentions, round(lat, 3) as lat, round(lon, 3) as lon from t""", rounded="lat lon", places=3)
def coordinate_mentions(spark, sf_dir):
    """Decimal and degree mentions of a sentence, and the numbers of the decimal one."""
    points = E.points(spark, sf_dir)
    gps = F.format_string("%.3f, %.3f", F.col("lat").cast("double"), F.col("lon").cast("double"))
    dms = F.concat((F.col("id") % 90).cast("string"), F.lit("°"), (F.col("id") % 60).cast("string"), F.lit("'N"))
    rows = points.select("id", X.coordinate_mentions(F.concat(F.lit("at "), gps, F.lit(" or "), dms, F.lit("; again "), dms)).alias("mentions"))
    place = X.lat_lon(F.element_at(F.filter("mentions", lambda m: F.contains(m, F.lit(","))), 1))
    return rows.select("id", "mentions", place["lat"].alias("lat"), place["lon"].alias("lon"))


@query("select p_partkey, label, regexp_matches(label, '[^\\x00-\\x7F]') or (not contains(label, ' ') and length(label) <= 6 and regexp_matches(label, '^[A-Z]') and label not in ('SMALL', 'Large')) as coined from (select p_partkey, unnest([p_type, p_name, p_brand, upper(left(p_name, 4)) || 'é']) as label from part)")
def coined_labels(spark, sf_dir):
    labels = F.array("p_type", "p_name", "p_brand", F.concat(F.upper(F.substring("p_name", 1, 4)), F.lit("é")))
    return E.table(spark, sf_dir, "part").select("p_partkey", F.explode(labels).alias("label")).withColumn("coined", C.is_coined(F.col("label"), ("SMALL", "Large")))


@query("select string_agg('curl -L -o ''' || n || '.png'' ''http://site/' || n || '.png''', chr(10) order by 'curl -L -o ''' || n || '.png'' ''http://site/' || n || '.png''') as script from (select distinct p_size as n from part order by 'http://site/' || p_size || '.png' limit 20)")
def download_script(spark, sf_dir):
    urls = E.table(spark, sf_dir, "part").select(F.concat(F.lit("http://site/"), F.col("p_size").cast("string"), F.lit(".png")).alias("image_url"))
    return sinks.download_script(urls, most=20)


@query(f"""with {spatial._CODES}, t as (select p_partkey, v1, v2, (case when v1 < 0 then '-' else '+' end) || lpad(abs(v1)::varchar, 3, '0') || (case when v2 < 0 then '-' else '+' end) || lpad(abs(v2)::varchar, 3, '0') as code, tagged from codes),
    kept as (select *, 'u' || (p_partkey % 40) as url, p_partkey % 2 = 0 as titled, case when tagged then 'MilDSP ' else 'note ' end || code || ' end' as text from t
        where tagged or not ((abs(v1) <= 31 and abs(v2) <= 31 and v1 < 0 and v2 < 0) or (abs(v1) < 20 and abs(v2) < 20 and v1 < 0))),
    hits as (select code, url, case when titled then 0 else 1 end as kind, case when titled then 'title' else text end as context from kept)
    select code, url, min(kind || context)[2:] as context from hits group by 1, 2""")
def codes_of_the_corpus(spark, sf_dir):
    """Codes in titles and in excerpts, each once per article, the title first."""
    rows = spatial._codes(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), (F.col("p_partkey") % 40).cast("string")))
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "MilDSP ").otherwise("note "), "code", F.lit(" end"))
    titled = F.col("p_partkey") % 2 == 0
    return codes.scanned(rows.filter(titled).select("url", text.alias("title")), rows.filter(~titled).select("url", text.alias("text")))
