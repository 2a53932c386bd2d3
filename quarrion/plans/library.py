"""Bibliography, label, topic and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.functions.text import cosine
from quarrion.operators import bibliography as B
from quarrion.operators import labelling as L
from quarrion.operators import ranking as R
from quarrion.operators import search as S
from quarrion.operators import topics as T
from quarrion.operators import vectors as V
from quarrion.operators.cooccurrence import pair_counts
from quarrion.plans import entities as E
from quarrion.plans.registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
BIB = E.BIBLIOGRAPHY


def _bib(spark, sf_dir):
    return E.bibliography(spark, sf_dir)


@query(
    f"""with {BIB}, p as (select author, count(*) as entries, count(distinct article_id) as articles, min(year) as lo, max(year) as hi from bib group by 1),
    t as (select author, substr(title, 1, 60) as t, min(article_id * 1000 + position) as pos from bib group by all),
    r as (select author, t, row_number() over (partition by author order by pos, t) as r from t),
    s as (select author, string_agg(t, '; ' order by r) as samples from r where r <= 3 group by 1)
    select author, entries, articles, lo || '-' || hi as years, samples from p join s using (author)"""
)
def author_stats(spark, sf_dir):
    return B.author_stats(_bib(spark, sf_dir))


FIELDS = {"Metals": ("brass", "steel", "tin"), "Finish": ("anodized", "polished", "plated"), "Kinds": ("economy", "standard", "promo")}


def _field_sql(column: str) -> str:
    score = [f"({' + '.join(f'contains({column}, {chr(39)}{k}{chr(39)})::int' for k in keys)})" for keys in FIELDS.values()]
    best = f"greatest({', '.join(score)})"
    return f"case when {best} = 0 then 'Other' " + " ".join(f"when {s} = {best} then '{n}'" for n, s in zip(FIELDS, score)) + " end"


@query(f"with {BIB}, a as (select author, lower(string_agg(distinct journal, ' ' order by journal)) as t from bib group by 1) select author, {_field_sql('t')} as field from a")
def author_fields(spark, sf_dir):
    text = _bib(spark, sf_dir).groupBy("author").agg(F.array_join(F.array_sort(F.collect_set("journal")), " ").alias("t"))
    return text.select("author", B.field_of(F.col("t"), FIELDS).alias("field"))


@query(f"with {BIB}, f as (select {_field_sql('lower(journal)')} as field, count(*) as n from bib group by 1) select field, n, round(100.0 * n / sum(n) over (), 1)::double as percent from f")
def field_shares(spark, sf_dir):
    return B.shares(_bib(spark, sf_dir).select(B.field_of(F.col("journal"), FIELDS).alias("field")), "field")


@query(
    f"""with {BIB}, top as (select author from bib group by 1 order by count(*) desc, author limit 50), x as (select distinct article_id, author from bib where author in (select author from top))
    select a.author as a, b.author as b, count(*) as weight from x a join x b on a.article_id = b.article_id and a.author < b.author group by all having count(*) >= 2 order by weight desc, a, b limit 50"""
)
def author_cocitation(spark, sf_dir):
    return B.cocitation(_bib(spark, sf_dir))


@query(f"with {BIB} select author, min(article_id) as first_article, max(article_id) as last_article, count(*) as n from bib group by 1")
def author_spans(spark, sf_dir):
    return _bib(spark, sf_dir).groupBy("author").agg(F.min("article_id").alias("first_article"), F.max("article_id").alias("last_article"), F.count("*").alias("n"))


@query(f"with {BIB} select journal, count(*) as n, count(distinct author) as authors from bib group by 1 order by n desc, journal limit 20")
def journals(spark, sf_dir):
    per = B.named(_bib(spark, sf_dir), "journal").groupBy("journal").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))
    return S.top(per, [F.desc("n"), F.col("journal")], 20)


@query(f"with {BIB} select publisher, count(*) as n from bib group by 1 order by n desc, publisher limit 20")
def publishers(spark, sf_dir):
    per = B.named(_bib(spark, sf_dir), "publisher").groupBy("publisher").agg(F.count("*").alias("n"))
    return S.top(per, [F.desc("n"), F.col("publisher")], 20)


@query(f"with {BIB} select (year // 10 * 10)::int as decade, count(*) as n from bib where year between 1000 and 2030 group by 1")
def decades(spark, sf_dir):
    rows = _bib(spark, sf_dir).filter(F.col("year").between(1000, 2030))
    return rows.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query(f"with {BIB} select author || ' (' || year || ')' as work, count(distinct article_id) as articles, count(*) as entries, arg_min(title, article_id * 1000 + position) as title from bib group by 1 order by articles desc, entries desc, work limit 20")
def most_cited_works(spark, sf_dir):
    return B.most_cited(_bib(spark, sf_dir))


@query(
    f"""with {E.LABELS}, {BIB}, c as (select article_id, count(*) as n from bib group by 1)
    select label, count(*) as articles, sum(n)::bigint as entries, round(sum(n) / count(*), 1)::double as density from labels join c using (article_id) group by 1"""
)
def citation_density(spark, sf_dir):
    counts = _bib(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("n"))
    rows = E.labels(spark, sf_dir).join(counts, "article_id").groupBy("label").agg(F.count("*").alias("articles"), F.sum("n").alias("entries"))
    return rows.withColumn("density", F.round(F.col("entries") / F.col("articles"), 1))


@query(f"with {E.ARTICLES}, {BIB} select month, count(*) as entries, count(distinct article_id) as articles, count(*) / count(distinct article_id) as per_article from bib join articles using (article_id) group by 1", dates="month", rounded="per_article")
def citation_timeline(spark, sf_dir):
    per = _bib(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("n")).join(E.articles(spark, sf_dir).select("article_id", "month"), "article_id")
    months = per.groupBy("month").agg(F.sum("n").alias("entries"), F.count("*").alias("articles"))
    return months.withColumn("per_article", F.col("entries") / F.col("articles"))


@query(f"with {BIB} select author, count(distinct article_id) as articles from bib group by 1 having count(distinct article_id) >= 2")
def cross_article_authors(spark, sf_dir):
    return _bib(spark, sf_dir).groupBy("author").agg(F.countDistinct("article_id").alias("articles")).filter("articles >= 2")


def _noisy(spark, sf_dir):
    n = F.col("article_id") % 7
    author = F.when(n == 0, F.repeat("author", 12)).when(n == 1, F.lit("dys yr")).otherwise(F.col("author"))
    entry = F.when(n == 2, F.lit("aeg egel sid of it")).when(n == 3, F.repeat(F.lit("word "), 120)).otherwise(F.col("title"))
    return _bib(spark, sf_dir).select("article_id", "position", author.alias("author"), entry.alias("entry_text"))


@query(
    f"""with {BIB}, x as (select case article_id % 7 when 0 then case when length(author) * 12 > 50 then 'author_too_long' end when 1 then 'fl_author_patterns' when 2 then 'fl_language_patterns' when 3 then 'unstructured_long_text' end as reason, title from bib)
    select coalesce(reason, 'kept') as reason, count(*) as n from x group by 1"""
)
def noise_reasons(spark, sf_dir):
    rows = _noisy(spark, sf_dir).select(F.coalesce(B.noise_reason(F.col("author"), F.col("entry_text")), F.lit("kept")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


_NUMBERED = f"with {BIB}, r as (select *, row_number() over (order by article_id, position, author, title, journal, year) as n from bib) select n, "


@query(
    _NUMBERED + r"""'@article{' || regexp_replace(split_part(split_part(author, ',', 1), ' ', 1), '[^A-Za-z0-9#]', '', 'g') || year::int || '_' || n || ',' || chr(10) || '  author = {' || author || '},' || chr(10)
    || '  title = {' || title || '},' || chr(10) || '  journal = {' || journal || '},' || chr(10) || '  year = {' || year::int || '}' || chr(10) || '}' as entry from r"""
)
def bibtex_entries(spark, sf_dir):
    return B.bibtex(_bib(spark, sf_dir))


@query(_NUMBERED + "concat_ws(chr(10), 'TY  - JOUR', 'AU  - ' || author, 'TI  - ' || title, 'JO  - ' || journal, 'PY  - ' || year::int, 'ER  - ') as entry from r")
def ris_entries(spark, sf_dir):
    return B.ris(_bib(spark, sf_dir))


_LABELS = E.LABELS
TOPICS, LANGUAGES = ("ECONOMY", "STANDARD", "PROMO"), ("Brand#11", "Brand#12", "Brand#13")


@query(
    f"""with {_LABELS}, co as (select a.label, count(*) as co, count(*) filter (where b.label in {TOPICS}) as t, count(*) filter (where b.label in {LANGUAGES}) as l from labels a join labels b on a.article_id = b.article_id and a.label <> b.label group by 1),
    n as (select label, count(*) as n from labels group by 1),
    s as (select label, n, co.t / co.co > 0.6 as bt, co.l / co.co > 0.6 as bl, regexp_matches(label, '^[A-Z][a-z]{{2,8}}$')::int as sh from n join co using (label)),
    p as (select label, n, case when bt then 2 else 0 end + sh as f, case when not bt and bl then 2 else 0 end as tp from s),
    q as (select *, f + (n >= 30 and f >= tp)::int as lg, 0.5 + case when n >= 30 and f >= tp then 0.1 else 0 end as base from p)
    select label, case when label in {TOPICS} then 'topic' when label in {LANGUAGES} then 'language' when lg > tp then 'language' when lg < tp then 'topic' else 'ambiguous' end as classification, n as article_count,
      round(case when label in {TOPICS + LANGUAGES} then 0.95 when lg = tp then base else least(0.9, base + 0.1 * abs(lg - tp)) end, 2)::double as confidence from q"""
)
def label_classes(spark, sf_dir):
    return L.classified(E.labels(spark, sf_dir).select("article_id", "label"), TOPICS, LANGUAGES)


@query(
    f"""with {_LABELS}, x as (select l_orderkey as article_id, count(*) as e from lineitem group by 1)
    select label, count(*) as n, min(month) as first, max(month) as last, greatest(1, 12 * (year(max(month)) - year(min(month))) + month(max(month)) - month(min(month)) + 1)::int as active_months, avg(e) as avg_excerpts
    from labels join x using (article_id) where label like 'Brand%' group by 1""",
    dates="first last",
    rounded="avg_excerpts",
)
def language_stats(spark, sf_dir):
    counts = E.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.count("*").alias("e"))
    rows = E.labels(spark, sf_dir).filter(F.col("label").startswith("Brand")).join(counts, "article_id")
    per = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"), F.avg("e").alias("avg_excerpts"))
    months = 12 * (F.year("last") - F.year("first")) + F.month("last") - F.month("first") + 1
    return per.withColumn("active_months", F.greatest(F.lit(1), months))


def _matrix(spark, sf_dir):
    own = E.labels(spark, sf_dir).select("article_id", "label")
    left, right = own.filter(F.col("label").startswith("Brand")), own.filter(~F.col("label").startswith("Brand"))
    both = left.join(right.select("article_id", F.col("label").alias("topic")), "article_id")
    return both.groupBy(F.col("label").alias("language"), "topic").agg(F.count("*").alias("n"))


_MATRIX = _LABELS + """, matrix as (select a.label as language, b.label as topic, count(*) as n from labels a join labels b on a.article_id = b.article_id where a.label like 'Brand%' and b.label not like 'Brand%' group by all)"""


@query(f"with {_MATRIX} select language, topic, n, sum(n) over (partition by language)::bigint as total from matrix")
def language_topic_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).withColumn("total", F.expr("sum(n) over (partition by language)"))


@query(
    f"""with {_LABELS}, m as (select label, month, count(*) as n from labels group by all), e as (select max(month) as hi from m),
    l as (select label, min(month) as birth, max(month) as last, sum(n)::bigint as total, arg_max(month, n * 100000 - epoch(month) / 86400) as peak from m group by 1)
    select label, birth, last, total, (datediff('month', birth, last) + 1)::int as lifespan_months, peak,
      case when last >= hi - interval 18 month then 'active' when last >= hi - interval 36 month then 'dormant' else 'retired' end as status from l, e""",
    dates="birth last peak",
)
def label_lifecycle(spark, sf_dir):
    return L.lifecycle(E.labels(spark, sf_dir).select("label", "month"))


@query(f"with {_LABELS}, b as (select label, min(year(month)) as year from labels group by 1) select year::int as year, count(*) as births from b group by 1")
def births_per_year(spark, sf_dir):
    first = E.labels(spark, sf_dir).groupBy("label").agg(F.min(F.year("month")).alias("year"))
    return first.groupBy("year").agg(F.count("*").alias("births"))


@query()
def label_families(spark, sf_dir):
    return L.families(_matrix(spark, sf_dir), "language", "topic", "n")


@query()
def family_summary(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    counts = E.labels(spark, sf_dir).groupBy(F.col("label").alias("language")).agg(F.count("*").alias("article_count"))
    return L.family_summary(L.families(matrix, "language", "topic", "n"), matrix, counts, "language", "topic", "n")


@query(f"with {_MATRIX}, f as (select language, n, topic, row_number() over (partition by language order by n desc, topic) as r from matrix) select language, string_agg(topic, ',' order by r) as top_topics from f where r <= 3 group by 1")
def top_topics(spark, sf_dir):
    best = S.top_per_group(_matrix(spark, sf_dir), ["language"], [F.desc("n"), F.col("topic")], 3)
    return best.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t")).select("language", F.array_join(F.transform("t", lambda x: x["topic"]), ",").alias("top_topics"))


_TFIDF = """own as (select doc_id, text from documents where length(text) >= 11),
t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as term from own) group by all),
v as (select term, count(*) as df, sum(tf) as total from t group by 1 having count(*) >= 5 and count(*) <= 0.85 * (select count(*) from own) order by total desc, term limit 5000),
w as (select doc_id, term, tf * (ln((1 + (select count(*) from own)) / (1 + df)) + 1) as w from t join v using (term)),
tfidf as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w)"""


@query(f"with {_TFIDF} select doc_id, term, w from tfidf", rounded="w")
def tfidf_weights(spark, sf_dir):
    return T.tfidf(E.table(spark, sf_dir, "documents"))


@query()
def topic_model(spark, sf_dir):
    weights = T.tfidf(E.table(spark, sf_dir, "documents"))
    doc_topics, terms = T.nmf(weights)
    return T.dominant(doc_topics).join(F.broadcast(T.topic_names(terms)), "topic").select("doc_id", "topic", "name", F.round("score", 3).alias("score"))


# Topics that both sides can derive: the article's remainder stands for a model's assignment.
_ASSIGNED = _LABELS + """, assigned as (select article_id as url, (article_id % 6)::int as topic, month, (article_id % 10) / 10.0 as score from articles)"""


def _assigned(spark, sf_dir):
    key = F.col("article_id")
    return E.articles(spark, sf_dir).select(key.alias("url"), (key % 6).cast("int").alias("topic"), "month", (key % 10 / 10).alias("score"), F.lit(0).alias("position"))


def _url_labels(spark, sf_dir):
    return E.label_sets(spark, sf_dir).select(F.col("article_id").alias("url"), "labels")


def _assigned_by_url(spark, sf_dir):
    return E.by_article(spark, sf_dir, _assigned(spark, sf_dir), "url")


@query(f"with {_ASSIGNED} select topic, count(distinct url) as articles from assigned group by 1")
def topic_articles(spark, sf_dir):
    return T.topic_articles(_assigned(spark, sf_dir))


_ALIGNED = _ASSIGNED + """, b as (select topic, url, label from assigned join labels on url = article_id), n as (select topic, count(distinct url) as n from b group by 1),
s as (select topic, label, count(*) / max(n) as share from b join n using (topic) group by all), k as (select *, row_number() over (partition by topic order by share desc, label) as rank from s),
aligned as (select topic, label, share, rank, max(share) over (partition by topic) < 0.3 as novel from k where rank <= 5)"""


@query(f"with {_ALIGNED} select topic, label, share, rank, novel from aligned", rounded="share")
def topic_alignment(spark, sf_dir):
    return T.alignment(_assigned_by_url(spark, sf_dir), _url_labels(spark, sf_dir))


@query(
    f"""with {_ALIGNED}, good as materialized (select distinct topic, label from aligned where share >= 0.3), la as materialized (select distinct article_id as url, label from labels),
    f as materialized (select distinct url, topic, score::double as score from assigned join la using (url) where score >= 0.5),
    told as materialized (select distinct f.url from f join la on la.url = f.url join good on good.topic = f.topic and good.label = la.label)
    select url, topic, score from f where url not in (select url from told)"""
)
def mislabelled_articles(spark, sf_dir):
    rows, labels = _assigned_by_url(spark, sf_dir), _url_labels(spark, sf_dir)
    return T.mislabelled(rows, labels, T.alignment(rows, labels))


@query(f"with {_ALIGNED} select label, sum(share) as total from aligned group by 1 order by round(sum(share), 6) desc, label limit 20", rounded="total")
def aligned_label_totals(spark, sf_dir):
    rows = T.alignment(_assigned_by_url(spark, sf_dir), _url_labels(spark, sf_dir)).groupBy("label").agg(F.sum("share").alias("total"))
    return S.top(rows, [F.round("total", 6).desc(), F.col("label")], 20)


@query(
    f"""with {_ASSIGNED}, e as (select min(month) as lo, max(month) as hi, max(month) - interval 12 month as cut from assigned),
    p as (select topic, count(distinct url) filter (where month >= cut) as recent, count(distinct url) filter (where month < cut) as earlier, max(datediff('day', lo, cut::date)) as days from assigned, e group by 1),
    r as (select *, recent / greatest(earlier / (days / 30) * 12, 0.1) as ratio from p)
    select topic, recent, earlier, ratio, case when ratio > 1.3 then 'rising' when ratio < 0.7 then 'declining' else 'stable' end as direction from r""",
    rounded="ratio",
)
def topic_trends(spark, sf_dir):
    return T.topic_trends(_assigned(spark, sf_dir))


@query(f"with {_ASSIGNED} select topic, month, count(distinct url) as articles from assigned group by all", dates="month")
def topic_timelines(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("topic", "month").agg(F.countDistinct("url").alias("articles"))


LABEL_WEIGHTS, TERM_WEIGHTS = {"Brand#11": 10, "Brand#12": 15}, {"thing": 5, "ation": 2, "heit": 1}
_SCORES = """l as (select article_id as url, sum(case label when 'Brand#11' then 10 when 'Brand#12' then 15 else 0 end) as l from labels group by 1),
t as (select doc_id as url, sum(5 * contains(lower(text), 'thing')::int + 2 * contains(lower(text), 'ation')::int + contains(lower(text), 'heit')::int) as t, least(count(*) * 0.5, 10) as e from documents group by 1),
scores as (select article_id as url, (coalesce(l, 0) + coalesce(t, 0) + coalesce(e, 0) + case when article_id % 4 = 0 then 15 else 0 end)::double as score, title as category
  from articles a left join l on l.url = a.article_id left join t on t.url = a.article_id)"""


def _scores(spark, sf_dir):
    articles = E.articles(spark, sf_dir).select(F.col("article_id").alias("url"), (F.col("article_id") % 4 == 0).alias("has_coordinates"))
    excerpts = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), "text")
    return R.importance(articles, _url_labels(spark, sf_dir), excerpts, LABEL_WEIGHTS, TERM_WEIGHTS, tasks=E.tasks(spark, sf_dir))


@query(f"with {_LABELS}, {_SCORES} select url, score from scores")
def importance_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(
    f"""with {_LABELS}, {_SCORES}, b as (select url, score from scores order by score desc, url limit 100), r as (select *, row_number() over (order by score desc, url) - 1 as i, count(*) over () as n from b)
    select url, score, (i + 1)::int as reading_order, case when i < 0.2 * n then 'beginner' when i < 0.6 * n then 'intermediate' else 'advanced' end as difficulty from r"""
)
def reading_list(spark, sf_dir):
    return R.reading_order(S.top(_scores(spark, sf_dir), [F.desc("score"), F.col("url")], 100))


CATEGORIES = {"economy": ("ECONOMY", "SMALL"), "languages": ("thing", "ation")}


@query(
    f"""with {_LABELS}, {_SCORES}, listed as (select article_id as url, label as matched, case label when 'ECONOMY' then 0 else 1 end as ord from labels where label in ('ECONOMY', 'SMALL')),
    told as (select doc_id as url, case when contains(lower(text), 'economy') then 'ECONOMY' else 'SMALL' end as matched, case when contains(lower(text), 'economy') then 0 else 1 end as ord from documents where contains(lower(text), 'economy') or contains(lower(text), 'small')),
    hits as (select url, matched, 0 as kind, ord from listed union all select url, matched, 1, ord from told),
    best as (select url, arg_min(matched, kind * 10 + ord) as matched from hits group by 1),
    r as (select url, matched, score, row_number() over (order by score desc, url) as reading_order, count(*) over () as n from best join scores using (url))
    select url, matched, score, reading_order, 'intermediate' as difficulty from r where reading_order - 1 >= 0.2 * n and reading_order - 1 < 0.6 * n order by reading_order limit 50"""
)
def topic_reading_list(spark, sf_dir):
    """The middle part of the list of a topic that is part of a category's name."""
    postings = E.labels(spark, sf_dir).select(F.col("label").alias("keyword"), F.col("article_id").alias("url"))
    excerpts = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), "text")
    return R.topic_reading_list("Econ", CATEGORIES, postings, excerpts, _scores(spark, sf_dir), 50, "intermediate", tasks=E.tasks(spark, sf_dir))


@query(
    f"""with {_LABELS}, {_SCORES}, g as (select *, row_number() over (order by score desc, url) as r, row_number() over (partition by category order by score desc, url) as c from scores where score > 10)
    select url, score, category from g where r <= 5 or c = 1 order by score desc, url limit 20"""
)
def starter_list(spark, sf_dir):
    rows = _scores(spark, sf_dir).join(E.articles(spark, sf_dir).select(F.col("article_id").alias("url"), F.col("title").alias("category")), "url")
    return R.diverse(rows, "category").select("url", "score", "category")


@query("with s as (select e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as similarity from embeddings e, embeddings q where q.vec_id = 0) select * from s order by similarity desc, vec_id limit 10", rounded="similarity")
def vector_search(spark, sf_dir):
    rows = E.table(spark, sf_dir, "embeddings")
    return V.nearest(rows, V.neighbors_of(rows, [0])).withColumnRenamed("found", "vec_id").select("vec_id", "similarity")


_ALL_NEIGHBORS = """select q, rank, found, similarity from (
    select q.vec_id as q, e.vec_id as found, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as similarity,
           row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as rank
    from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id) where rank <= 10"""


@query(_ALL_NEIGHBORS, rounded="similarity")
def indexed_neighbors(spark, sf_dir):
    """The ten nearest of every fiftieth vector through the index, made exact by the cells' bounds."""
    rows = E.table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    return V.build_index(rows).search(asked, exact=True)


@query(
    """with m as (select list(x order by i) as mean from (select i, avg(x) as x from (select unnest(embedding)::double as x, unnest(range(1, 65)) as i from embeddings where label = 3) group by i)),
    s as (select label, list_cosine_similarity(embedding::double[], mean) as s from embeddings, m where label <> 3)
    select label, max(s) as similarity from s group by 1 order by round(max(s), 6) desc, label limit 10""",
    rounded="similarity",
)
def similar_groups(spark, sf_dir):
    return R.similar_groups(E.table(spark, sf_dir, "embeddings"), "label", 3)


@query("select a.vec_id, list_cosine_similarity(a.embedding, b.embedding) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", rounded="similarity")
def neighbor_similarity(spark, sf_dir):
    rows = E.table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", cosine(F.col("embedding"), F.col("other")).alias("similarity"))


@query(f"with {E.POSTINGS} select keyword, count(*) as n from postings group by 1 order by n desc, keyword limit 20")
def trending_keywords(spark, sf_dir):
    per = E.postings(spark, sf_dir).groupBy("keyword").agg(F.count("*").alias("n"))
    return S.top(per, [F.desc("n"), F.col("keyword")], 20)


@query(
    f"""with {E.POSTINGS}, k as (select url, keyword as matched, case keyword when 'Brand#11' then 0 else 1 end as ord, 0 as kind from postings where keyword in ('Brand#11', 'Brand#12')),
    t as (select doc_id as url, 'thing' as matched, 0 as ord, 1 as kind from documents where contains(lower(text), 'thing'))
    select url, arg_min(matched, kind * 10 + ord) as matched from (select * from k union all select * from t) group by 1"""
)
def matched_keywords(spark, sf_dir):
    posted = E.postings(spark, sf_dir).filter(F.col("keyword").isin("Brand#11", "Brand#12"))
    keyword_hits = posted.select("url", F.col("keyword").alias("matched"), F.when(F.col("keyword") == "Brand#11", 0).otherwise(1).alias("ord"))
    text_hits = E.table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("thing"))).select(F.col("doc_id").alias("url"), F.lit("thing").alias("matched"), F.lit(0).alias("ord"))
    return R.hits_by_priority(keyword_hits, text_hits)


@query(f"with {BIB}, x as (select distinct article_id, journal from bib) select a.journal as a, b.journal as b, count(*) as weight from x a join x b on a.article_id = b.article_id and a.journal < b.journal group by all")
def journal_pairs(spark, sf_dir):
    return pair_counts(_bib(spark, sf_dir), "article_id", "journal")
