"""Search, text function and extraction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrion.functions import extract as X
from quarrion.functions import text as C
from quarrion.operators import pagetree as P
from quarrion.operators import search as S
from quarrion.plans import entities as E
from quarrion.plans.registry import Registry
from quarrion.storage import written

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

TERMS = ("thing", "ation", "heit", "ment", "ción")
_HAS = ", ".join(f"case when contains(lower(text), '{t}') then '{t}' end" for t in TERMS)
WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


def _docs(spark, sf_dir):
    return E.table(spark, sf_dir, "documents")


@query(f"select doc_id from documents where contains(lower(text), 'with') and (contains(lower(text), 'thing') or contains(lower(text), 'heit')) and {WORDS} >= 50")
def search_text(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("keywords", C.tag_terms(F.col("text"), TERMS))
    return S.search(rows, "With", ("thing", "heit"), 50, keywords="keywords").select("doc_id")


@query("select doc_id, lang from documents where regexp_matches(text, '(?i)th[aeo]n\\s+on') order by doc_id limit 20")
def regex_search(spark, sf_dir):
    return S.top(_docs(spark, sf_dir).filter(F.col("text").rlike(r"(?i)th[aeo]n\s+on")).select("doc_id", "lang"), [F.col("doc_id")], 20)


@query("select doc_id, regexp_replace(substr(text, 1, 300), '(?i)(the)', '<mark>\\1</mark>', 'g') as marked from documents where contains(lower(text), 'the') order by doc_id limit 50")
def highlighted_search(spark, sf_dir):
    hits = _docs(spark, sf_dir).filter(F.contains(F.lower("text"), F.lit("the")))
    return S.top(hits.select("doc_id", C.highlight(F.col("text"), "the").alias("marked")), [F.col("doc_id")], 50)


@query("select d.doc_id, n_chars, quality from documents d join labels l using (doc_id) where text ilike '%password%' or text ilike '%with%' order by n_chars desc, doc_id limit 20")
def like_search(spark, sf_dir):
    hits = _docs(spark, sf_dir).filter(F.col("text").ilike("%password%") | F.col("text").ilike("%with%")).select("doc_id", "n_chars")
    return S.top(hits.join(E.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), [F.desc("n_chars"), F.col("doc_id")], 20)


@query(f"with {E.LABELS}, l as (select article_id, list(label) as ls from labels group by 1) select l.article_id from l join articles a using (article_id) where list_contains(ls, 'Brand#11') and contains(a.title, 'URGENT')")
def label_and_title_search(spark, sf_dir):
    labels = E.labels(spark, sf_dir).groupBy("article_id").agg(F.collect_set("label").alias("labels"))
    rows = labels.filter(F.array_contains("labels", "Brand#11")).join(E.articles(spark, sf_dir).select("article_id", "title"), "article_id")
    return rows.filter(F.contains("title", F.lit("URGENT"))).select("article_id")


@query(f"with {E.LABELS}, l as (select article_id, string_agg(label, ',' order by label) as ls from labels group by 1) select article_id from l where contains(lower(ls), 'd#12')")
def label_substring_search(spark, sf_dir):
    labels = E.labels(spark, sf_dir).groupBy("article_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return labels.filter(F.contains(F.lower(F.array_join("labels", ",")), F.lit("d#12"))).select("article_id")


@query("select c_custkey from customer where contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_mktsegment)), 'build')")
def any_column_search(spark, sf_dir):
    return S.any_column(E.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "Build").select("c_custkey")


@query(f"with {E.BIBLIOGRAPHY} select author, count(*) as n from bib where contains(year::varchar, '199') group by author")
def year_filter(spark, sf_dir):
    rows = E.bibliography(spark, sf_dir).filter(F.contains(F.col("year").cast("string"), F.lit("199")))
    return rows.groupBy("author").agg(F.count("*").alias("n"))


@query(f"with {E.POINTS} select id, type, lat from points where type = 'BUILDING' and contains(lower(title), '1') order by lat desc, id limit 40", rounded="lat")
def points_filtered_sorted(spark, sf_dir):
    rows = E.points(spark, sf_dir).filter((F.col("type") == "BUILDING") & F.contains(F.lower("title"), F.lit("1")))
    return S.top(rows.select("id", "type", "lat"), [F.desc("lat"), F.col("id")], 40)


def _images(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("jpg", "png", "gif"))), (F.col("p_size") % 3 + 1).cast("int"))
    return E.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://img/"), F.col("p_partkey"), F.lit("."), kind).alias("image_url"), F.col("p_name").alias("alt_text"), kind.alias("file_type"), (F.col("p_size") % 7 == 0).cast("int").alias("is_header"))


_IMAGES = "images as (select p_partkey as id, 'https://img/' || p_partkey || '.' || (['jpg', 'png', 'gif'])[p_size % 3 + 1] as image_url, p_name as alt_text, (['jpg', 'png', 'gif'])[p_size % 3 + 1] as file_type, (p_size % 7 = 0)::int as is_header from part)"


@query(f"with {_IMAGES} select id, file_type from images where contains(lower(alt_text), 'a') and file_type = 'png' and is_header = 1")
def image_filter(spark, sf_dir):
    return _images(spark, sf_dir).filter(F.contains(F.lower("alt_text"), F.lit("a")) & (F.col("file_type") == "png") & (F.col("is_header") == 1)).select("id", "file_type")


@query(f"with {_IMAGES}, t as (select file_type, count(*) as n from images group by 1) select sum(n)::bigint as total, (select count(*) from images where is_header = 1) as headers, arg_max(file_type, n * 100 - ascii(file_type)) as common_type from t")
def image_stats(spark, sf_dir):
    per = _images(spark, sf_dir).groupBy("file_type").agg(F.count("*").alias("n"), F.sum("is_header").alias("h"))
    return per.agg(F.sum("n").alias("total"), F.sum("h").alias("headers"), F.max_by("file_type", F.struct("n", -F.ascii("file_type"))).alias("common_type"))


@query(f"with {_IMAGES} select file_type, count(*) as n, sum(is_header)::bigint as headers from images group by 1")
def image_types(spark, sf_dir):
    return _images(spark, sf_dir).groupBy("file_type").agg(F.count("*").alias("n"), F.sum("is_header").alias("headers"))


GROUPS = {"Ones": ("Brand#11", "Brand#12", "Brand#13"), "Twos": ("Brand#21", "Brand#22")}


@query(f"with {E.LABELS} select case when label in {GROUPS['Ones']} then 'Ones' when label in {GROUPS['Twos']} then 'Twos' else 'Other' end as category, count(*) as n from labels group by 1")
def keyword_categories(spark, sf_dir):
    return E.labels(spark, sf_dir).groupBy(S.bucketed(F.col("label"), GROUPS).alias("category")).agg(F.count("*").alias("n"))


@query(
    f"""with {E.LABELS}, l as (select article_id, list(label) as ls from labels group by 1),
    c as (select case when list_has_any(ls, ['Brand#11']) then 'defense' when list_has_any(ls, ['Brand#12', 'Brand#13']) then 'locations' else 'general' end as category from l)
    select category, count(*) as n from c group by 1"""
)
def article_categories(spark, sf_dir):
    labels = E.labels(spark, sf_dir).groupBy("article_id").agg(F.collect_set("label").alias("labels"))
    rules = (("defense", ("Brand#11",)), ("locations", ("Brand#12", "Brand#13")))
    return labels.groupBy(S.primary_category(F.col("labels"), rules).alias("category")).agg(F.count("*").alias("n"))


@query(f"select term as keyword, count(*) as n from (select unnest(list_filter([{_HAS}], lambda x: x is not null)) as term from documents) group by 1")
def keyword_frequency(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(C.tag_terms(F.col("text"), TERMS)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"select doc_id, {WORDS} as words, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) as ascii_ratio, length(text) as chars from documents", rounded="ascii_ratio")
def text_measures(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", C.word_count(text).alias("words"), C.ascii_ratio(text).alias("ascii_ratio"), F.length(text).alias("chars"))


_STOP = "[" + ", ".join(f"'{w}'" for w in C.ENGLISH) + "]"


@query(
    f"""with d as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) as w from documents),
    h as (select doc_id, len(list_intersect(w, {_STOP})) as h, len(w) as n from d) select doc_id, h >= 3 and h > 0.12 * n as english from h"""
)
def english_test(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.is_english(F.col("text")).alias("english"))


@query("select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as clean, substr(md5(text), 1, 16) as hash from documents")
def cleaned_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.clean_text(F.col("text")).alias("clean"), C.text_hash(F.col("text")).alias("hash"))


@query(f"with {E.ARTICLES} select article_id, regexp_extract(url, '/(\\d{{4}})/(\\d{{2}})/', 1) || '-' || regexp_extract(url, '/(\\d{{4}})/(\\d{{2}})/', 2) as month from articles")
def month_from_url(spark, sf_dir):
    return E.articles(spark, sf_dir).select("article_id", C.month_from_url(F.col("url")).alias("month"))


@query("""with d as (select o_orderkey as id, o_orderdate, o_orderkey % 5 as k from orders)
    select id, case k when 0 then o_orderdate::date when 1 then date_trunc('month', o_orderdate)::date when 2 then date_trunc('month', o_orderdate)::date when 3 then date_trunc('year', o_orderdate)::date end as parsed from d""", dates="parsed")
def parsed_dates(spark, sf_dir):
    shapes = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy-MM", "MMM yyyy", "yyyy")] + [F.lit("no date")]
    text = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return E.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.parse_date(text).alias("parsed"))


@query("""with d as (select p_partkey as id, (['2004', '2004.0', '2004a', 'c. 1998', '999', '2031', 'vol 1987 x'])[p_partkey % 7 + 1] as y from part)
    select id, case y when '2004' then 2004 when '2004.0' then 2004 when 'c. 1998' then 1998 when 'vol 1987 x' then 1987 end as year from d""")
def clean_years(spark, sf_dir):
    forms = ("2004", "2004.0", "2004a", "c. 1998", "999", "2031", "vol 1987 x")
    text = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return E.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.clean_year(text).alias("year"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, event_type from events")
def json_properties(spark, sf_dir):
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nand no more."))
    return E.table(spark, sf_dir, "events").select("event_id", F.from_json(C.fenced_json(answer), "k long")["k"].alias("k"), "event_type")


@query(
    """select page_id, left(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 200) as title,
    len(regexp_extract_all(html, '(?is)<a[^>]*rel=["'']tag["''][^>]*>(.*?)</a>')) as labels, len(list_distinct(regexp_extract_all(html, '(?i)<a[^>]*href=["'']([^"'']+)["'']', 1))) as links
    from (select page_id, replace(html, '<li><a href=', '<li><a rel="tag" href=') as html from pages)""",
    places=0,
)
def page_metadata(spark, sf_dir):
    """Pages whose menu entries are given as labels."""
    html = F.replace("html", F.lit("<li><a href="), F.lit('<li><a rel="tag" href='))
    return E.table(spark, sf_dir, "pages").select("page_id", X.page_title(html).alias("title"), F.size(X.page_labels(html)).alias("labels"), F.size(X.page_links(html)).alias("links"))


RULES = (("Metal", ("brass", "steel", "tin")), ("Color", ("red", "green", "blue")), ("Ring", ("ring",)))


@query("select p_partkey, case when regexp_matches(lower(p_name), 'brass|steel|tin') then 'Metal' when regexp_matches(lower(p_name), 'red|green|blue') then 'Color' when contains(lower(p_name), 'ring') then 'Ring' else 'Other' end as category from part")
def title_categories(spark, sf_dir):
    return E.table(spark, sf_dir, "part").select("p_partkey", S.title_category(F.col("p_name"), RULES).alias("category"))


@query("""with n as (select user_id, event_type, count(*) as n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as r from n)
    select user_id, string_agg(event_type || '=' || n, ',' order by r) filter (where r <= 3) as top, coalesce(max(n) filter (where event_type = 'error'), 0)::bigint as errors, coalesce(max(n) filter (where event_type = 'none'), -1)::bigint as none, count(*) as kinds from r group by 1""")
def event_maps(spark, sf_dir):
    """Counts of a user's events as a map: its largest entries, and entries that are there or not."""
    per = E.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    top = F.array_join(F.transform(C.by_value(F.col("m"), 3), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return maps.select("user_id", top.alias("top"), C.value_of(F.col("m"), "error").cast("long").alias("errors"), C.value_of(F.col("m"), "none", -1).cast("long").alias("none"), F.cardinality("m").cast("long").alias("kinds"))


# Pages with the marks of a blog's posts, made from the pages' own: the article is the post's body, menu entries are its labels,
# and its heading is the caption of an image, once as a figure's and once as the element after it.
_POSTS = """posts as (select page_id, replace(html, '&', '+') as h from pages),
    split as (select page_id, h, regexp_extract(h, '(?s)<article>(.*)</article>', 1) as body, regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1) as head from posts)"""


def _posts(spark, sf_dir):
    html = F.regexp_replace("html", "&", "+")
    html = F.regexp_replace(F.regexp_replace(html, "<article>", "<div class='x post-body'>"), "</article>", "</div>")
    html = F.regexp_replace(html, "<li><a href=", "<li><a rel='nofollow tag' href=")
    image = "<img src='/i.png' alt='A'>"
    html = F.regexp_replace(html, "<h1>(.*?)</h1>", f"<figure>{image}<figcaption>$1</figcaption></figure><section>{image}<!-- c --><p>$1</p></section><section>{image}text<hr><p>$1</p></section>")
    # Written, as every operator on nodes reads them several times: pages are parsed once.
    return written(P.page_nodes(E.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))))


@query(f"""with {_POSTS}, a as (select page_id, regexp_extract_all(regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1) as l from posts)
    select page_id, (unnest(range(1, len(l) + 1)) - 1)::int as place, unnest(l) as label from a""")
def page_label_rows(spark, sf_dir):
    """Labels of posts by where they stand in the page."""
    return P.labels(_posts(spark, sf_dir))


@query(f"""with {_POSTS}, b as (select page_id, regexp_replace(body, '(?s)<h1>(.*?)</h1>', '<i>\\1</i><i>\\1</i><i>text</i><i>\\1</i>') as b from split)
    select page_id, regexp_replace(regexp_replace(b, '(?s)<!--.*?-->', '<i>', 'g'), '(<[^>]*>)+', chr(10), 'g') as text from b""")
def post_bodies(spark, sf_dir):
    """All texts of a post's body, one below the other."""
    found = P.post_bodies(_posts(spark, sf_dir))
    return found.select("page_id", F.concat(F.lit("\n"), "text", F.lit("\n")).alias("text"))


@query(f"""with {_POSTS}, c as (select page_id, trim(regexp_replace(head, '<[^>]*>', '', 'g')) as c from split)
    select page_id, k, case k when 0 then left(c, 500) when 1 then case when length(c) < 200 then c end end as caption from c, range(3) r(k) where (select count(*) from split s where s.page_id = c.page_id and h like '%<h1>%') > 0""")
def image_captions(spark, sf_dir):
    """Captions of three images a page: in a figure, by the next element, and none."""
    found = P.image_captions(_posts(spark, sf_dir))
    k = F.row_number().over(Window.partitionBy("page_id").orderBy("node")) - 1
    return found.select("page_id", k.cast("long").alias("k"), "caption")


@query("select distinct page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*href=[\"'']([^\"'']+)[\"'']', 1)) as link from pages")
def page_links(spark, sf_dir):
    return E.table(spark, sf_dir, "pages").select("page_id", F.explode(X.page_links(F.col("html"))).alias("link"))


@query("select page_id, split_part(url, '://', 1) as scheme, split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1) as host from pages")
def url_parts(spark, sf_dir):
    return E.table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


_SENTENCES = """s as (select conv_id, turn, unnest(regexp_extract_all(text, '([A-Z][a-z][^.!?]{40,250}[.!?])', 1)) as raw from conversations),
c as (select conv_id, turn, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as text from s where length(regexp_replace(raw, '[^\\x00-\\x7F]', '', 'g')) / length(raw) > 0.95)"""


@query(f"with {_SENTENCES} select distinct conv_id, turn, substr(md5(text), 1, 16) as hash, length(text) as chars from c where length(text) >= 30 and len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 6")
def narrative_excerpts(spark, sf_dir):
    rows = E.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.excerpts(F.col("text"), ("NoSuchTermHere",))).alias("e"))
    return rows.filter("e.category = 'narrative'").select("conv_id", "turn", F.col("e.hash").alias("hash"), F.length("e.text").alias("chars")).distinct()


_TOLD = ("with", "from")


@query(
    f"""with told as (select conv_id, turn, '"' || substr(text, 1, 120) || '" and *' || substr(text, 121, 100) || '* ' || text as text from conversations),
    s as (select conv_id, turn, unnest(regexp_extract_all(text, '"([^"]{{25,}})"', 1)) as raw, 6 as least, 0.8 as share from told
      union all select conv_id, turn, unnest(regexp_extract_all(text, '\\*([^*]{{30,}})\\*', 1)), 8, 0.8 from told
      union all select conv_id, turn, unnest(regexp_extract_all(text, '([A-Z][^.!?]*(?:{'|'.join(_TOLD)})[^.!?]*[.!?])', 1)), 10, 0.9 from told),
    c as (select conv_id, turn, replace(replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), '  ', ' ') as text, least, share from s),
    w as (select *, {WORDS} as words from c)
    select distinct conv_id, turn, substr(md5(text), 1, 16) as hash, words from w where length(text) >= 30 and words >= least and length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) >= share"""
)
def spoken_excerpts(spark, sf_dir):
    """Turns whose first part stands in quotes and whose next is starred."""
    told = F.concat(F.lit('"'), F.substring("text", 1, 120), F.lit('" and *'), F.substring("text", 121, 100), F.lit("* "), "text")
    rows = E.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.spoken_excerpts(told, _TOLD)).alias("e"))
    return rows.select("conv_id", "turn", C.text_hash(F.col("e.text")).alias("hash"), F.col("e.words").alias("words")).distinct()


def _cited(spark, sf_dir):
    b = E.bibliography(spark, sf_dir)
    name = F.initcap(F.regexp_replace("author", "[^A-Za-z]", ""))
    forms = F.array(F.concat(name, F.lit(" ("), F.col("year"), F.lit(")")), F.concat(F.lit("("), name, F.lit(" "), F.col("year"), F.lit(")")), F.concat(F.lit("("), name, F.lit(", "), F.col("year"), F.lit(")")))
    return b.select("article_id", "position", F.concat(F.lit("as in "), F.element_at(forms, (F.col("position") % 3 + 1).cast("int")), F.lit(" it was.")).alias("text"))


@query(
    f"""with {E.BIBLIOGRAPHY}, n as (select article_id, position, upper(regexp_replace(author, '[^A-Za-z]', '', 'g')[1]) || lower(regexp_replace(author, '[^A-Za-z]', '', 'g')[2:]) as name, year from bib)
    select article_id, position, case position % 3 when 0 then 'author_year' when 1 then 'parenthetical' else 'parenthetical_comma' end as type, name as author, year::varchar as year, 6 as at from n"""
)
def inline_citations(spark, sf_dir):
    rows = _cited(spark, sf_dir).select("article_id", "position", F.explode(X.citations(F.col("text"))).alias("c"))
    return rows.select("article_id", "position", "c.type", "c.author", "c.year", F.col("c.position").alias("at"))


@query(
    f"""with {E.BIBLIOGRAPHY}, e as (select article_id, position, author, title, journal, year from bib)
    select article_id, position, author, year::varchar as year, title, null::varchar as doi from e"""
)
def bibliography_entries(spark, sf_dir):
    b = E.bibliography(spark, sf_dir)
    entry = F.concat(F.lit("Body text.\n\nReferences\n\n"), F.col("author"), F.lit(" ("), F.col("year"), F.lit('). "'), F.col("title"), F.lit('". Published somewhere.'))
    rows = b.select("article_id", "position", F.explode(X.bibliography_lines(entry)).alias("line"))
    return rows.select("article_id", "position", X.bibliography_entry(F.col("line")).alias("e")).select("article_id", "position", "e.author", "e.year", "e.title", "e.doi")


@query("select p_partkey as id, 2 as n, 'FL-' || lpad((p_partkey % 1000000)::varchar, 6, '0') as first from part")
def reference_codes(spark, sf_dir):
    code = F.concat(F.lit("FL-"), F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0"))
    rows = E.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.references(F.concat(F.lit("see "), code, F.lit(" and fl_010203, FL-99."), code, F.lit("; ")), broad=False).alias("r"))
    return rows.select("id", F.size("r").alias("n"), F.element_at("r", 1).alias("first"))


@query("""with s as (select doc_id, substr(md5(trim(x)), 1, 16) as hash, min(i) as position from (select doc_id, unnest(string_split_regex(text, '[.!?]+')) as x, unnest(range(0, len(string_split_regex(text, '[.!?]+')))) as i from documents) where trim(x) <> '' group by 1, 2)
    select hash, arg_min(doc_id, doc_id * 100000 + position) as doc_id from s group by hash""")
def corpus_distinct_sentences(spark, sf_dir):
    """The first writer of each sentence hash wins."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "[.!?]+")).alias("position", "x")).filter("trim(x) != ''")
    hashed = rows.select("doc_id", "position", C.text_hash(F.trim("x")).alias("hash"))
    return S.first_rows(hashed, ["hash"], ["doc_id", "position"]).select("hash", "doc_id")


_ENGLISH = "[" + ", ".join(f"'{w}'" for w in C.ENGLISH) + "]"


@query(
    f"""with q as (select doc_id, list_concat(regexp_extract_all(text, '"([^"]{{25,}})"', 1), list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 60)) as s from documents),
    w as (select doc_id, i, s[i] as x, list_distinct(list_filter(string_split_regex(lower(s[i]), '\\s+'), lambda w: w <> '')) as words from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from q)),
    e as (select doc_id, list([x] order by i) as l from w where len(list_intersect(words, {_ENGLISH})) >= 3 and len(list_intersect(words, {_ENGLISH})) > 0.12 * len(words) group by 1)
    select doc_id, unnest(list_reduce(list_prepend([]::varchar[], l), lambda a, b: case when len(list_filter(a, lambda z: contains(z, b[1]) or contains(b[1], z))) > 0 then a else list_concat(a, b) end)) as sentence from e"""
)
def english_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(X.english_sentences(F.col("text"))).alias("sentence"))


@query("select source, arg_min(substr(text, 1, 200), doc_id) as summary from documents group by source")
def first_summary(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.min_by(F.substring("text", 1, 200), "doc_id").alias("summary"))


@query("select o_orderstatus as status, count(*) as n, coalesce(sum(o_totalprice), 0) as total from orders group by 1", rounded="total", places=2)
def status_breakdown(spark, sf_dir):
    return E.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0)).alias("total"))


@query("select count(*) as documents, sum(n_chars)::bigint as chars, count(distinct source) as sources from documents")
def batch_totals(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


@query("select p_partkey as id, replace(replace(p_name, ' ', '%20'), '#', '%23') as encoded, 'https://site.org/x/' || p_partkey || '.JPG' as url, 'jpg' as ext from part")
def url_functions(spark, sf_dir):
    rel = F.concat(F.lit("/x/"), F.col("p_partkey"), F.lit(".JPG"))
    return E.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.url_encode(F.col("p_name")).alias("encoded"), C.resolve_url(rel, "https://site.org/a/b.html").alias("url"), C.extension(rel).alias("ext"))
