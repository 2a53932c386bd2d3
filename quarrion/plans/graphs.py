"""Co-occurrence and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.operators import cooccurrence as O
from quarrion.operators import graph as G
from quarrion.operators import search as S
from quarrion.operators.cliques import group_triangles
from quarrion.operators.overlap import overlapping
from quarrion.plans import entities as E
from quarrion.plans.registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

EDGES = E.LABELS + """, edges as (select a.label as a, b.label as b, count(*) as weight from labels a join labels b on a.article_id = b.article_id and a.label < b.label group by all),
sym as (select a, b, weight from edges union all select b, a, weight from edges)"""
# Postings of parts as keywords: many short lists.
POSTED = """posted as (select distinct l_orderkey as url, 'part' || l_partkey as keyword from lineitem)"""


def _edges(spark, sf_dir):
    return O.set_pair_counts(E.label_sets(spark, sf_dir), "labels")


def _posted(spark, sf_dir):
    return E.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.concat(F.lit("part"), "l_partkey").alias("keyword")).distinct()


@query(f"with {EDGES} select a, b, weight from edges")
def label_pairs(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"with {EDGES} select a, b, weight from edges where a like 'Brand%' and b like 'Brand%' order by weight desc, a, b limit 50")
def language_pairs(spark, sf_dir):
    own = E.label_sets(spark, sf_dir).select(F.filter("labels", lambda x: x.startswith("Brand")).alias("labels"))
    return S.top(O.set_pair_counts(own, "labels"), [F.desc("weight"), F.col("a"), F.col("b")], 50)


@query(f"with {EDGES}, n as (select label, count(*) as articles from labels group by 1) select label, articles, count(b) as degree, coalesce(avg(weight), 0) as avg_weight from n left join sym on a = label group by 1, 2", rounded="avg_weight", places=2)
def label_stats(spark, sf_dir):
    nodes = E.labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("articles"))
    return G.node_stats(nodes, _edges(spark, sf_dir))


@query(f"with {EDGES} select a as label, count(*) as degree, sum(weight)::bigint as weight from sym group by 1 order by degree desc, weight desc, label limit 10")
def hub_labels(spark, sf_dir):
    per = G.symmetric(_edges(spark, sf_dir)).groupBy(F.col("a").alias("label")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    return S.top(per, [F.desc("degree"), F.desc("weight"), F.col("label")], 10)


_CUT = """, e2 as (select a, b, weight from edges where weight >= (select quantile_disc(weight, 0.5) from edges)), s2 as (select a, b, weight from e2 union all select b, a, weight from e2)"""


def _strong(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    middle = edges.agg(F.expr("percentile_disc(0.5) within group (order by weight)").cast("bigint").alias("cut"))
    return edges.crossJoin(F.broadcast(middle)).filter("weight >= cut").drop("cut")


@query(
    f"""with {EDGES}{_CUT}, deg as (select a as node, count(*) as degree from s2 group by 1 having count(*) >= 2),
    near as (select a as node, b from (select *, row_number() over (partition by a order by weight desc, b) as r from s2) where r <= 100 and a in (select node from deg)),
    w as (select x.node, x.b as x, y.b as y from near x join near y on x.node = y.node and x.b < y.b),
    p as (select w.node, count(*) as pairs, count(e.a) as linked from w left join e2 e on e.a = w.x and e.b = w.y group by 1)
    select node, degree, pairs, (pairs - linked) / pairs as bridge_score, (pairs - linked) / pairs * degree as weighted_score from p join deg using (node)""",
    rounded="bridge_score weighted_score",
)
def bridge_labels(spark, sf_dir):
    """Over all neighbours on strong edges, however many; the SQL counts the 100 heaviest, which is the same up to that degree."""
    return G.bridge_scores(_strong(spark, sf_dir))


@query(
    f"""with {EDGES}, deg as (select a as node, count(*) as degree from sym group by 1 having count(*) >= 2),
    w as (select x.a as node, x.b as x, y.b as y from sym x join sym y on x.a = y.a and x.b < y.b),
    p as (select w.node, count(*) as pairs, count(e.a) as linked from w left join edges e on e.a = w.x and e.b = w.y group by 1)
    select node, degree, pairs, (pairs - linked) / pairs as bridge_score, (pairs - linked) / pairs * degree as weighted_score from p join deg using (node)""",
    rounded="bridge_score weighted_score",
)
def bridge_labels_exact(spark, sf_dir):
    """Over all neighbours of all labels, however many."""
    return G.bridge_scores(_edges(spark, sf_dir), max_neighbors=None)


@query("""with near as (select distinct l_suppkey as s, l_partkey as p from lineitem),
    e as (select distinct least(x.s, y.s) as a, greatest(x.s, y.s) as b from near x join near y on x.p = y.p and x.s <> y.s),
    t as (select x.a, x.b, y.b as c from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b)
    select node, count(*) as triangles from (select a as node from t union all select b from t union all select c from t) group by 1""")
def supplier_triangles(spark, sf_dir):
    """Triangles of suppliers that deliver a part in common."""
    return group_triangles(E.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query(
    f"""with {EDGES}{_CUT}, near as (select a as node, b as n from (select *, row_number() over (partition by a order by weight desc, b) as r from s2) where r <= 10),
    p as (select x.node, x.n as a, y.n as b from near x join near y on x.node = y.node and x.n < y.n where not exists (select 1 from e2 where e2.a = x.n and e2.b = y.n))
    select node, a, b from (select *, row_number() over (partition by node order by a, b) as r from p) where r <= 3"""
)
def unlinked_neighbors(spark, sf_dir):
    return G.unlinked_examples(_strong(spark, sf_dir))


_GROUPS = """, thin as (select s_suppkey as a, s_suppkey + 6 as b from supplier where s_suppkey + 6 <= (select max(s_suppkey) from supplier)),
e3 as (select a, b from thin union select b, a from thin),
walk(n, c) as (select s_suppkey, s_suppkey from supplier union select w.n, e3.b from walk w join e3 on w.c = e3.a),
comp as (select n as id, min(c) as root, count(*) as size from walk group by 1)"""


def _thin(spark, sf_dir):
    keys = E.table(spark, sf_dir, "supplier").select("s_suppkey")
    most = keys.agg(F.max("s_suppkey").alias("m"))
    other = F.col("s_suppkey") + 6
    return keys.crossJoin(F.broadcast(most)).filter(other <= F.col("m")).select(F.col("s_suppkey").alias("a"), other.alias("b"), F.lit(9).alias("weight"))


@query("with recursive " + _GROUPS[2:] + " select id, case when size = 1 then 'Other' else root::varchar end as community from comp")
def communities(spark, sf_dir):
    nodes = E.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return G.communities(nodes, _thin(spark, sf_dir), node="id").select("id", "community")


_MEMBERS = """, m as (select id, case when size = 1 then 'Other' else root::varchar end as community from comp),
    i as (select distinct l_suppkey, l_orderkey from lineitem)"""


def _members(spark, sf_dir):
    """Community of each supplier as a label, and the labels of each order as an article."""
    nodes = E.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return G.communities(nodes, _thin(spark, sf_dir), node="id"), E.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_orderkey").distinct()


@query(
    "with recursive "
    + _GROUPS[2:]
    + _MEMBERS
    + """, per as (select community, id, count(l_orderkey) as c from m left join i on l_suppkey = id group by all),
    t as (select community, id as top_label from per qualify row_number() over (partition by community order by c desc, id) = 1)
    select community, count(distinct id) as size, count(distinct l_orderkey) as articles, any_value(top_label) as top_label from m left join i on l_suppkey = id join t using (community) group by 1"""
)
def community_summary(spark, sf_dir):
    member, items = _members(spark, sf_dir)
    rows = member.join(items, "id", "left")
    per = rows.groupBy("community", "id").agg(F.count("l_orderkey").alias("c")).groupBy("community").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("top_label"))
    return rows.groupBy("community").agg(F.countDistinct("id").alias("size"), F.countDistinct("l_orderkey").alias("articles")).join(per, "community")


@query(
    "with recursive "
    + _GROUPS[2:]
    + _MEMBERS
    + """ select l_orderkey as article_id, count(*) as labels, count(distinct community) as communities from i join m on l_suppkey = id group by 1 order by communities desc, labels desc, article_id limit 30"""
)
def hub_articles(spark, sf_dir):
    member, items = _members(spark, sf_dir)
    per = items.join(member, "id").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.count("*").alias("labels"), F.countDistinct("community").alias("communities"))
    return S.top(per, [F.desc("communities"), F.desc("labels"), F.col("article_id")], 30)


@query(f"with {EDGES} select case when a = 'Brand#11' then b else a end as neighbor, weight from edges where a = 'Brand#11' or b = 'Brand#11' order by weight desc, neighbor limit 15")
def ego_network(spark, sf_dir):
    return G.ego_network(_edges(spark, sf_dir), "Brand#11", 15)


@query(f"with {POSTED}, rare as (select keyword from posted group by 1 having count(*) <= 500), p as (select * from posted where keyword in (select keyword from rare)) select x.url as a, y.url as b, count(*) as weight from p x join p y on x.keyword = y.keyword and x.url < y.url group by all having count(*) >= 2")
def article_network(spark, sf_dir):
    """Articles that share at least two labels, labels of more than 500 articles left out."""
    return _article_pairs(_posted(spark, sf_dir), 500, 2)


def _article_pairs(posted, max_df: int, least: int):
    rare = posted.groupBy("keyword").count().filter(F.col("count") <= max_df).select("keyword")
    return overlapping(posted.join(rare, "keyword"), "url", "keyword", least)


@query(f"with {POSTED} select x.url as a, y.url as b, count(*) as weight from posted x join posted y on x.keyword = y.keyword and x.url < y.url group by all having count(*) >= 2")
def keyword_network(spark, sf_dir):
    """Each two urls that share at least two keywords."""
    return overlapping(_posted(spark, sf_dir), "url", "keyword", 2)


# Customers and the weeks in which they ordered: few keys, each in many sets.
_WEEKS = """w as (select distinct o_custkey as c, date_trunc('week', o_orderdate) as k from orders)"""


@query(f"with {_WEEKS} select x.c as a, y.c as b, count(*) as weight from w x join w y on x.k = y.k and x.c < y.c group by all having count(*) >= 3")
def customers_of_same_weeks(spark, sf_dir):
    """Each two customers that ordered in at least three weeks alike: an overlap join of common keys."""
    weeks = E.table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("week", "o_orderdate").alias("k"))
    return overlapping(weeks, "o_custkey", "k", 3)


@query(
    f"""with {POSTED}, n as (select keyword, count(*) as n from posted group by 1),
    r as (select url, keyword, row_number() over (partition by url order by n desc, keyword) as r from posted join n using (keyword))
    select url, count(*) as keyword_count, string_agg(keyword, ',' order by r) filter (where r <= 5) as top_keywords from r group by 1"""
)
def keyword_nodes(spark, sf_dir):
    """The nodes of the keyword network."""
    return O.keyword_nodes(_posted(spark, sf_dir)).withColumn("top_keywords", F.array_join("top_keywords", ","))


@query(f"with {POSTED}, t as (select keyword from posted where url = 7) select url, count(*) as score from posted where keyword in (select keyword from t) and url <> 7 group by 1 order by score desc, url limit 20")
def similar_articles(spark, sf_dir):
    posted = _posted(spark, sf_dir)
    keys = posted.filter("url = 7").select("keyword")
    per = posted.filter("url != 7").join(keys, "keyword", "left_semi").groupBy("url").agg(F.count("*").alias("score"))
    return S.top(per, [F.desc("score"), F.col("url")], 20)


@query(f"with {E.POSTINGS} select url from postings where keyword = 'Brand#11' intersect select url from postings where keyword = 'Brand#12'")
def both_keywords(spark, sf_dir):
    posted = E.postings(spark, sf_dir)
    return posted.filter("keyword = 'Brand#11'").select("url").intersect(posted.filter("keyword = 'Brand#12'").select("url"))


@query(f"""with {E.ARTICLES}, t as (select article_id, 'FL-' || lpad((article_id * 7 % 1000000)::varchar, 6, '0') as ref, title from articles)
    select article_id as src, ref, left('as told in ' || ref || ', ' || repeat(title || ' ', 12), 100) as context from t""")
def reference_edges(spark, sf_dir):
    code = F.concat(F.lit("FL-"), F.lpad((F.col("article_id") * 7 % 1000000).cast("string"), 6, "0"))
    text = F.concat(F.lit("as told in "), code, F.lit(", "), F.repeat(F.concat("title", F.lit(" ")), 12))
    return G.reference_edges(E.articles(spark, sf_dir).select(F.col("article_id").alias("src"), text.alias("text")), "src")


def _path_level(seen: str, frontier: str, before: str) -> str:
    """The first three new urls of each key of the frontier, as many as the path still has room for."""
    return f"""(select url from (select distinct url from (
        select p.url, row_number() over (partition by p.keyword order by p.url) as r from posted p
        where p.keyword in (select keyword from posted where url in ({frontier})) and p.url not in ({seen})) where r <= 3) order by url limit 20 - {before})"""


@query(
    f"""with {POSTED}, one as {_path_level("7", "7", "1")}, two as {_path_level("select 7 union all select url from one", "select url from one", "1 - (select count(*) from one)")}
    select 7 as url, 0 as depth union all select url, 1 from one union all select url, 2 from two"""
)
def reading_path(spark, sf_dir):
    return G.reading_path(_posted(spark, sf_dir), 7)
