"""State, trees, factors, indexes and positions: the library's operators that need more than one aggregation."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion.functions import text as C
from quarrion.operators import numbering, pagetree, ranking, search, significance, topics, vectors
from quarrion.sources import files
from quarrion.streaming import incremental, queue


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 40, 3000), rng.integers(-5, 6, 3000), strict=True))]
    rows = spark.createDataFrame(data, "k int, id int, v int").withColumn("w", F.when(F.col("id") % 3 > 0, F.col("v"))).repartition(6)
    got = numbering.running_sums(rows, ["k", "id"], {"sv": "v", "sw": "w"}).orderBy("k", "id").collect()
    ordered = sorted(data)
    assert [r.sv for r in got] == np.cumsum([v for *_, v in ordered]).tolist()
    assert [r.sw for r in got] == np.cumsum([v if i % 3 else 0 for _, i, v in ordered]).tolist()
    assert numbering.running_sums(rows.limit(0), ["k"], {"s": "v"}).count() == 0


# Streams


def test_ingest_does_not_read_its_target(spark, tmp_path):
    """Batch after batch; what was written before is gone when the later ones run, and each key is still taken once."""
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in range(8):
        spark.createDataFrame([(k, i) for k in range(i, i + 3)] + [(None, i)], "id int, v int").coalesce(1).write.mode("append").parquet(source)
    incremental.ingest(spark, source, "id int, v int", target, check, ["id"], "v != 3", files_per_batch=2)
    first = sorted((r.id is None, r.id or 0) for r in spark.read.parquet(target).select("id").collect())
    assert first == [(False, k) for k in range(10)] + [(True, 0)]
    (tmp_path / "out").rename(tmp_path / "gone")
    for i in range(8, 12):
        spark.createDataFrame([(k, i) for k in range(i, i + 3)], "id int, v int").coalesce(1).write.mode("append").parquet(source)
    incremental.ingest(spark, source, "id int, v int", target, check, ["id"], "v != 3", files_per_batch=2)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(10, 14))
    log = spark.read.json(target + "_log")
    assert log.agg(F.sum("rows"), F.sum("new")).first()[:] == (8 * 4 + 4 * 3, 10 + 1 + 4)


EVENTS = [
    ("a", "found", 0), ("a", "failed", 10), ("a", "done", 20), ("b", "found", 0), ("c", "failed", 5), ("c", "failed", 30), ("d", "failed", 1), ("d", "failed", 2), ("d", "failed", 3),
    ("e", "failed", 95), ("f", "done", 50), ("f", "failed", 60), (None, "done", 1), ("g", None, 1), ("h", "found", 99), ("i", "failed", 60), ("i", "failed", 70),
]


START = 1_600_000_000


@pytest.mark.parametrize("per_batch", [1, 100])
def test_queue_stream_equals_its_batch_form(spark, tmp_path, per_batch):
    """Whatever the batches, the last status of a url is the one of the whole table; waits end by timers."""
    rows = spark.createDataFrame(EVENTS, "url string, kind string, minute int").select("url", "kind", F.timestamp_seconds(START + F.col("minute") * 60).alias("at"))
    ordered = sorted(EVENTS, key=lambda e: e[2])
    for k in range(0, len(ordered), 5):
        part = spark.createDataFrame(ordered[k : k + 5], "url string, kind string, minute int").select("url", "kind", F.timestamp_seconds(START + F.col("minute") * 60).alias("at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r.url: (r.status, r.failures) for r in queue.queue_status(rows, F.lit(START * 1000 + (99 - 10) * 60_000), wait_ms=30 * 60_000).collect()}
    assert {x[0] for x in want.values()} == {"done", "dead", "waiting", "pending"} and want["c"] == ("waiting", 2) and want["e"] == ("waiting", 1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    got = queue.run_queue(stream, str(tmp_path / "out"), str(tmp_path / "check"), wait_ms=30 * 60_000, late="10 minutes")
    assert {r.url: (r.status, r.failures) for r in got.collect()} == want


# Documents


@pytest.mark.parametrize("indent", [None, 1])
def test_json_members_in_pieces(spark, tmp_path, indent):
    """Strings with commas, brackets, quotes and escapes; nested members; several files, read in many blocks."""
    rng = np.random.default_rng(2)
    nasty = ["a,b", 'say "x, y"', "[{", "}]", "back\\slash,", "é,日", "", '\\",', "tab\t,"]
    items = [{"url": f"u{i}", "title": str(rng.choice(nasty)), "labels": [str(x) for x in rng.choice(nasty, rng.integers(0, 4))], "excerpt_count": i, "coordinates": []} for i in range(300)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps(items[:299], indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "a/two.json").write_text("\n " + json.dumps(items[299:], indent=indent), encoding="utf-8")
    (tmp_path / "a/none.json").write_text("[]\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = files.json_elements(spark, str(tmp_path / "a"))
        assert sorted((r.file.rsplit("/", 1)[1], r.element, json.dumps(json.loads(r.value), sort_keys=True)) for r in found.collect()) == sorted([("one.json", i, json.dumps(x, sort_keys=True)) for i, x in enumerate(items[:299])] + [("two.json", 0, json.dumps(items[299], sort_keys=True))])
        rows = files.articles(spark, str(tmp_path / "a")).collect()
        assert sorted((r.url, r.title, tuple(r.labels)) for r in rows) == sorted((x["url"], x["title"], tuple(x["labels"])) for x in items)
        index = {f"k,{i}": [{"url": f"u{i}", "text": str(rng.choice(nasty))}, f"plain{i}"] for i in range(100)}
        (tmp_path / "index.json").write_text(json.dumps(index, indent=indent))
        posted = files.keyword_index(spark, str(tmp_path / "index.json")).collect()
        assert sorted((r.keyword, r.position, r.url, r.text) for r in posted) == sorted(x for k, (a, b) in index.items() for x in ((k, 0, a["url"], a["text"]), (k, 1, b, None))) or len(posted) == 200
        assert spark.read.option("lineSep", ",").text(str(tmp_path / "a/one.json")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_crawl_of_a_thousand_pages(spark):
    links = spark.range(1, 1501).select(F.concat(F.lit("p"), "id").alias("url"), F.concat(F.lit("p"), F.col("id") + 1).alias("older"))
    got = files.crawl(links, ["p1", "p1490"], 1000)
    assert got.filter("start = 'p1'").agg(F.count("*"), F.max("page")).first()[:] == (1000, 1000)
    assert got.filter("start = 'p1490'").count() == 12


PAGE = """<html><head><title>Site: Old  </title></head><body><h3 class="big post-title"> Head &amp; line </h3>
<a rel="tag" href=x>One</a><a rel='nofollow tag'> Two <b>more</b></a><a rel=next>No</a>
<div class="post-body entry"><p>First<br>line<script>var x;</script></p><div>in</div><!-- c --> tail</div>
<figure><img src="a.png" alt="A"><figcaption> Cap <i>one</i></figcaption></figure>
<div><img src="b.png"> text <em>Next</em><p>Far</p></div><div><img src="c.png"><table><tr><td>no</td></tr></table></div>
<p><img src="d.png" alt="D"></p><div><img src="e.png"><span>%s</span></div><img><div><img src="f.png"><img src="g.png"><i></i></div></body></html>""" % ("long " * 50)


def test_page_tree(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<title>Site: Only</title><p>x<p>y</b>z"), (3, None), (4, "")], "page_id int, html string")
    nodes = pagetree.page_nodes(pages).cache()
    assert {r.page_id: r.title for r in pagetree.post_titles(nodes, prefix="Site:").collect()} == {1: "Head & line", 2: "Only"}
    assert [(r.place, r.label) for r in pagetree.labels(nodes).orderBy("place").collect()] == [(0, "One"), (1, "Twomore")]
    assert {r.page_id: r.text for r in pagetree.post_bodies(nodes).collect()} == {1: "First\nline\nin\n tail", 2: "Site: Only\nx\ny\nz"}
    captions = {r.src: (r.alt, r.caption) for r in pagetree.image_captions(nodes).collect()}
    assert captions == {"a.png": ("A", "Capone"), "b.png": ("", "Next"), "c.png": ("", None), "d.png": ("D", None), "e.png": ("", None), "f.png": ("", None), "g.png": ("", "")}
    inside = nodes.filter("tag = 'div'").collect()
    assert all(r.last >= r.node for r in inside) and nodes.filter("page_id = 1 and node = 0").first()["last"] == nodes.filter("page_id = 1").agg(F.max("node")).first()[0]


# Factors


def dense_nmf(a: np.ndarray, topics_: int, rounds: int = 400) -> float:
    """Squared error of alternating coordinate descent on a dense matrix from the same kind of start."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    h = np.zeros((topics_, a.shape[1]))
    h[0] = np.sqrt(s[0]) * np.abs(vt[0])
    for k in range(1, topics_):
        x, y = u[:, k], vt[k]
        plus, minus = (np.linalg.norm(np.maximum(z * x, 0)) * np.linalg.norm(np.maximum(z * y, 0)) for z in (1, -1))
        own = np.maximum(y if plus >= minus else -y, 0)
        h[k] = np.sqrt(s[k] * max(plus, minus)) * own / np.linalg.norm(own)
    h[h <= 1e-9] = a.mean()
    w = np.full((len(a), topics_), 0.1)
    for _ in range(rounds):
        w = topics._descended(w, a @ h.T, h @ h.T, 5)
        h = topics._descended(h.T, a.T @ w, w.T @ w, 5).T
    return float(((a - w @ h) ** 2).sum())


def themed(spark, seed: int = 3):
    rng = np.random.default_rng(seed)
    words = [[f"{t}{chr(97 + i)}word" for i in range(15)] for t in "abcd"]
    docs = [(i, " ".join(rng.choice(words[i % 4], 30).tolist() + rng.choice(words[(i + 1) % 4], 6).tolist())) for i in range(160)]
    return topics.tfidf(spark.createDataFrame(docs, "doc_id long, text string"), min_df=2)


def test_nmf_equals_a_dense_factorisation(spark):
    weights = themed(spark).cache()
    rows = weights.collect()
    terms = sorted({r.term for r in rows})
    a = np.zeros((160, len(terms)))
    for r in rows:
        a[r.doc_id, terms.index(r.term)] = r.w
    docs, found = topics.nmf(weights, topics=4, tol=1e-6)
    w, h = np.zeros((160, 4)), np.zeros((4, len(terms)))
    for r in docs.collect():
        w[r.doc_id, r.topic] = r.weight
    for r in found.collect():
        h[r.topic, terms.index(r.term)] = r.weight
    error = float(((a - w @ h) ** 2).sum())
    assert error <= 1.01 * dense_nmf(a, 4) and (w >= 0).all()
    best = w.argmax(1)
    assert len({tuple(sorted(set(best[k::4].tolist()))) for k in range(4)}) == 4 and all(len(set(best[k::4].tolist())) == 1 for k in range(4))


def test_singular_vectors_equal_the_dense_ones(spark):
    rng = np.random.default_rng(4)
    a = rng.random((60, 20)) * (rng.random((60, 20)) < 0.4)
    rows = spark.createDataFrame([(np.flatnonzero(x).tolist(), x[np.flatnonzero(x)].tolist()) for x in a], "i array<int>, w array<double>").repartition(4)
    sizes, v = topics.term_vectors(rows, 20, 5, steps=12)
    s, vt = np.linalg.svd(a)[1:]
    assert sizes == pytest.approx(s[:5], rel=1e-3)
    assert np.abs((v * vt[:5].T).sum(0)) == pytest.approx(np.ones(5), abs=1e-2)


def test_nmf_does_not_depend_on_the_partitioning(spark):
    weights = themed(spark).cache()
    results = []
    for parts in (1, 7):
        docs, terms = topics.nmf(weights.repartition(parts), topics=4)
        results.append(({r.doc_id: r.topic for r in topics.dominant(docs).collect()}, {r.topic: r.name for r in topics.topic_names(terms).collect()}))
    assert results[0] == results[1]
    with pytest.raises(ValueError):
        topics.nmf(weights, most_terms=3)


# Vectors


def test_index_recall_and_exactness(spark):
    """Of the ten nearest by a whole scan, the index finds nine at least with a few cells, and all of them when it is exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(4000, [0.0] * 16), (4001, None)], "vec_id long, embedding array<float>")
    index = vectors.build_index(rows, cells=64, sample=1500)
    asked = rows.filter("vec_id % 50 = 0 and vec_id < 4000").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    like = unit[::50] @ unit.T
    like[np.arange(80), np.arange(0, 4000, 50)] = -2
    want = {50 * k: set(np.argsort(-row, kind="stable")[:10].tolist()) for k, row in enumerate(like)}
    got: dict = {}
    for r in index.search(asked, probes=8).collect():
        got.setdefault(r.q, set()).add(r.found)
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9
    exact: dict = {}
    for r in index.search(asked, probes=2, exact=True).collect():
        exact.setdefault(r.q, set()).add(r.found)
    assert exact == want
    assert index.rows.count() == 4002


# Samples


def test_two_samples(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 400).round(2), rng.normal(0.3, 1.5, 250).round(2)
    rows = spark.createDataFrame([(float(v), 1) for v in a] + [(float(v), 0) for v in b] + [(None, 1)], "x double, own int").repartition(5)
    r = significance.two_samples(rows, "x", "own").first()
    points = np.unique(np.concatenate([a, b]))
    gap = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    va, vb = a.var(ddof=1) / 400, b.var(ddof=1) / 250
    size = 400 * 250 / 650 * gap * gap
    assert r.ks == pytest.approx(gap) and r.t == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb)) and r.df == pytest.approx((va + vb) ** 2 / (va**2 / 399 + vb**2 / 249))
    assert r.ks_p == pytest.approx(2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * size) for j in range(1, 101)), abs=1e-9) and r.ratio == pytest.approx(a.mean() / b.mean())


# Lists, titles and maps


def test_topic_reading_list(spark):
    kinds = {"fruit": ("apple", "Pear"), "tools": ("saw",)}
    assert ranking.topic_terms("Fru", kinds) == ["apple", "Pear"] and ranking.topic_terms("see-saw", kinds) == ["saw"] and ranking.topic_terms("Other", kinds) == ["Other"]
    postings = spark.createDataFrame([("Pear", "u1"), ("apple", "u1"), ("saw", "u2"), ("apple", "u9")], "keyword string, url string")
    excerpts = spark.createDataFrame([("u3", "a PEAR tree"), ("u1", "saw"), ("u4", None), ("u5", "pear and apples"), ("u8", "apple")], "url string, text string")
    scores = spark.createDataFrame([(f"u{i}", float(10 - i)) for i in range(1, 7)], "url string, score double")
    got = ranking.topic_reading_list("fruit", kinds, postings, excerpts, scores)
    assert [(r.url, r.matched, r.reading_order, r.difficulty) for r in got.collect()] == [("u1", "apple", 1, "beginner"), ("u3", "Pear", 2, "intermediate"), ("u5", "apple", 3, "advanced")]
    assert [r.url for r in ranking.topic_reading_list("fruit", kinds, postings, excerpts, scores, difficulty="advanced").collect()] == ["u5"]


def test_title_rules_and_maps(spark):
    titles = ["A MilOrb", "cassini weapon", "The Diskus", "golay", "Dreams", "Probe", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = [r.c for r in rows.select("i", search.title_category(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["Defense", "Defense", "Cassini Diskus", "NodeSpaces", "XViS", "Contact", "Other", "Other"]
    entry = spark.createDataFrame([("Entry event 4",), ("Akrij",), ("x",)], "t string").select(search.title_category(F.col("t"), search.COORDINATE_RULES, "Location").alias("c"))
    assert [r.c for r in entry.collect()] == ["Entry Event", "PSV Operation", "Location"]
    maps = spark.createDataFrame([({"a": 1, "b": 3, "c": 3},), ({},), (None,)], "m map<string,int>")
    out = maps.select(C.value_of(F.col("m"), "a", -1).alias("a"), C.by_value(F.col("m"), 2).alias("top")).collect()
    assert [r.a for r in out] == [1, -1, -1] and [tuple(e) for e in out[0].top] == [("b", 3), ("c", 3)] and out[1].top == [] and out[2].top is None


def test_a_database_table_is_read_in_ranges(spark, tmp_path):
    """Through JDBC with the embedded database that comes with Spark: all rows, in as many tasks as asked for."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "THINGS").save()
    whole = files.jdbc(spark, url, "THINGS")
    assert sorted((r.ID, r.NAME) for r in whole.collect()) == [(i, f"n{i}") for i in range(100)]
    parts = files.jdbc(spark, url, "THINGS", "ID", (0, 100), 4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100 and parts.filter("ID < 7").count() == 7
