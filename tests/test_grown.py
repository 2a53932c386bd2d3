"""Queries on tables with what larger inputs hold: repeated values, dense graphs, long lists."""

from __future__ import annotations

import json
import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import DATA, connection, same
from pyspark.sql import functions as F

from quarrion import storage
from quarrion.operators import cliques, graph, overlap, subsets, vectors
from quarrion.plans import catalog, entities, ingestion, layouts
from quarrion.sources import files
from quarrion.streaming import incremental, queue


@pytest.fixture
def tables(tmp_path):
    """A copy of the smallest tables, for a test to change."""
    return shutil.copytree(DATA, tmp_path / "tables")


def replaced(df, folder, name):
    """df in place of the folder's table."""
    (folder / f"{name}.parquet").chmod(0o644)
    pq.write_table(df.toArrow(), folder / f"{name}.parquet")


def test_stored_pages_of_one_url(spark, tables):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    url = F.when(F.col("page_id") % 7 == 0, F.lit("http://site/same")).when(F.col("page_id") % 11 > 0, F.col("url"))
    replaced(pages.withColumn("url", url), tables, "pages")
    same(catalog.QUERIES["stored_pages"](spark, str(tables)), catalog.ORACLE["stored_pages"], connection(str(tables)))


def test_labels_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500, raising=False)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert entities.labels(spark, DATA).rdd.getNumPartitions() >= n > 8
    for name in ("label_pairs", "label_stats", "topic_alignment"):
        same(catalog.QUERIES[name](spark, DATA), catalog.ORACLE[name], connection())


#: Queries over labels by article.
OF_LABELS = ("label_stats", "topic_alignment", "mislabelled_articles", "aligned_label_totals", "bridge_labels_exact", "hub_labels", "unlinked_neighbors", "ego_network", "bridge_labels", "importance_scores", "topic_reading_list")


@pytest.mark.parametrize("name", OF_LABELS)
def test_tasks_of_labels_stay_small_in_a_session_of_many_partitions(spark, monkeypatch, name):
    """The session's partitions would be merged to a few tasks, and joins of label rows would sort them twice over."""
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    with storage.conf(spark, {"spark.sql.shuffle.partitions": "200", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert n <= entities.labels(spark, DATA).rdd.getNumPartitions() < 200
        df = catalog.QUERIES[name](spark, DATA)
        plan = df._jdf.queryExecution().executedPlan().toString()
        same(df, catalog.ORACLE[name], connection())
    by_article = [line for line in plan.splitlines() if "hashpartitioning(article_id" in line or "hashpartitioning(url" in line]
    assert all("REPARTITION_BY_NUM" in line for line in by_article)
    assert not any("Join" in line and "article_id" in line for line in plan.splitlines())


def test_an_article_that_is_listed_twice_has_its_labels_once(spark, tables):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    twice = orders.unionByName(orders.filter("o_orderkey % 3 = 0")).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")))
    replaced(twice.filter("o_orderkey % 7 > 0"), tables, "orders")
    for name in ("label_stats", "label_first_seen"):
        same(catalog.QUERIES[name](spark, str(tables)), catalog.ORACLE[name], connection(str(tables)))


def test_bridge_labels_count_all_neighbours(spark, tables):
    """A brand that stands with 150 types, and types in twos: over 100 neighbours, and the SQL without its limit gives the same."""
    part = spark.read.parquet(f"{DATA}/part.parquet")
    n = F.col("p_partkey") % 150
    replaced(part.withColumn("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit("Brand#hub")).otherwise(F.concat(F.lit("Brand#"), n % 7))).withColumn("p_type", F.concat(F.lit("type"), n)), tables, "part")
    df = catalog.QUERIES["bridge_labels"](spark, str(tables))
    assert df.agg(F.max("degree"), F.max("pairs")).first() >= (101, 101 * 100 // 2)
    same(df, catalog.ORACLE["bridge_labels"].replace("r <= 100 and ", ""), connection(str(tables)))


def test_triangles_send_a_list_once_to_a_group(spark, monkeypatch):
    """Three complete graphs of 30 nodes: an edge's list goes to the group of its start, so few lists are moved."""
    rows = spark.range(3).select(F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 29)).alias("a"), (F.col("id") * 100).alias("k"))
    edges = rows.select("a", F.explode(F.sequence("k", F.col("k") + 29)).alias("b")).filter("a < b")
    for most in (100, 10_000):
        monkeypatch.setattr(graph, "GROUP_EDGES", most)
        assert {r.triangles for r in graph.triangles(edges).collect()} == {29 * 28 // 2}
    moved = []
    kept = graph.shipped
    monkeypatch.setattr(graph, "shipped", lambda df: moved.append(df.agg(F.sum(F.size("to"))).first()[0]) or kept(df))
    assert graph.triangles(edges.withColumn("a", F.concat(F.lit("n"), "a")).withColumn("b", F.concat(F.lit("n"), "b"))).count() == 90
    assert moved[0] <= 2 * edges.count()


@pytest.mark.parametrize("most", [0, 10**9])
def test_triangles_of_groups(spark, monkeypatch, most):
    """Nodes of three strips, by lists and by bits: random groups, repeated ones, a long one, null nodes and groups. Against sets of neighbours."""
    monkeypatch.setattr(cliques, "SPARSE", most)
    rng = np.random.default_rng(5)
    groups = [rng.choice(40_000, size=k, replace=False) * 7 for k in (*rng.integers(2, 7, 6000), 60)]
    groups += [groups[3], groups[4][:2], *(rng.choice(300, size=12, replace=False) * 7 for _ in range(300))]
    near: dict = {}
    for own in groups:
        for x in map(int, own):
            near.setdefault(x, set()).update(map(int, own))
    want = {x: n for x, own in near.items() if (n := sum(len(own & near[y]) - 2 for y in own if y != x) // 2)}
    rows = [(int(x), g) for g, own in enumerate(groups) for x in own] + [(None, 1), (14, None), (int(groups[0][0]), 0)] + [(x * 7, -x) for x in range(1, 40_000)]
    got = {r.node: r.triangles for r in cliques.group_triangles(spark.createDataFrame(rows, "s long, p long"), "s", "p").collect()}
    assert got == want


def test_links_of_groups_take_two_bytes(spark, monkeypatch):
    """Pairs that many groups have are sent once, and never as rows; the query of many links for its nodes makes no list of edges."""
    lists = pa.array([list(range(0, 600, 3))] * 300 + [list(range(1, 3000))], pa.list_(pa.int32()))
    sent = list(cliques._blocked(iter([pa.record_batch([lists.slice(at, 50)], ["members"]) for at in range(0, 301, 50)])))
    links = {(a, b) for a in range(0, 600, 3) for b in range(a + 3, 600, 3)} | {(a, b) for a in range(1, 3000) for b in range(a + 1, 3000)}
    assert sum(len(x.as_buffer()) for batch in sent for x in batch.column("places")) <= 2 * len(links) * 1.01 and sum(map(len, sent)) < 200
    merged = [r for batch in cliques._merged(iter([pa.Table.from_batches(sent).sort_by("block").combine_chunks().to_batches()[0]])) for r in batch.to_pylist()]
    assert sum(r["n"] for r in merged) == len(links) and sum(len(r["places"]) for r in merged) < 2 * len(links)
    monkeypatch.setattr(cliques, "triangles", None)
    same(catalog.QUERIES["supplier_triangles"](spark, DATA), catalog.ORACLE["supplier_triangles"], connection())


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Cells are dealt to blocks, and copies are ranked by key, also over blocks; few rows leave a block."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(3).normal(size=(120, 8))
    rows = spark.createDataFrame([(i, x[i % 120 if i >= 40 else 0].tolist()) for i in range(360)], "vec_id long, embedding array<float>")
    index = vectors.build_index(rows, cells=4)
    assert index.sizes.sum() == 360 and index.sizes.max() > 16
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    got: dict = {}
    for r in index.search(asked, exact=True).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.found)
    held = [x[i % 120 if i >= 40 else 0].astype(np.float32).astype(float) for i in range(360)]
    for q in range(0, 360, 50):
        like = [(-round(float(v @ held[q] / np.linalg.norm(v) / np.linalg.norm(held[q])), 12), i) for i, v in enumerate(held) if i != q]
        assert got[q] == [i for _, i in sorted(like)[:10]]


def test_clips_of_one_file_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(ingestion, "TASK_CLIPS", 2, raising=False)
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert ingestion._clips(spark, DATA).rdd.getNumPartitions() == -(-n // 2) > 1


def test_pages_are_parsed_once(spark):
    plan = catalog.QUERIES["post_bodies"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_terms_are_counted_where_their_texts_are(spark):
    with storage.conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = catalog.QUERIES["tfidf_weights"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sets_of_common_keys_meet_in_products(spark, monkeypatch, kind):
    """Few keys, each in many sets: blocks meet, and no candidate is joined. The join gives the same pairs."""
    sets = {i: sorted(set(np.random.default_rng(i).integers(0, 40, 1 + i % 12).tolist())) for i in range(150)}
    rows = spark.createDataFrame([(i, k) for i, own in sets.items() for k in own], "item long, key long").withColumn("item", F.col("item").cast(kind))
    as_kind = {"long": int, "string": str}[kind]
    want = sorted((*sorted((as_kind(a), as_kind(b))), len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 3)
    for block, strip, columns in ((8192, 512, 1024), (20, 7, 16)):
        for name, value in (("BLOCK", block), ("STRIP", strip), ("COLUMNS", columns)):
            monkeypatch.setattr(overlap, name, value, raising=False)
        found = overlap.overlapping(rows, "item", "key", 3)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(overlap, "ENTRIES", 0)
    assert sorted(map(tuple, overlap.overlapping(rows, "item", "key", 3).collect())) == want


def _shared(sets: list, least: int) -> dict:
    held = np.zeros((len(sets), 1 + max(map(max, sets))), np.int64)
    for i, own in enumerate(sets):
        held[i, own] = 1
    n = held @ held.T
    return {(int(i), int(j)): int(n[i, j]) for i, j in zip(*np.nonzero(np.triu(n >= least, 1)), strict=True)}


def test_sets_of_few_keys_meet_by_subsets(spark, monkeypatch):
    """4,000 sets of eight keys of 340, some alike: no two blocks are multiplied, which takes time by the square of the sets."""
    monkeypatch.setattr(overlap, "_multiplied", None)
    rng = np.random.default_rng(6)
    sets = [rng.choice(340, size=8, replace=False) for _ in range(3900)]
    sets += sets[:100]
    rows = spark.createDataFrame([(i, int(k)) for i, own in enumerate(sets) for k in own] + [(None, 1), (3, None)], "item long, key long")
    assert {(r.a, r.b): r.weight for r in overlap.overlapping(rows, "item", "key", 3).collect()} == _shared(sets, 3)


@pytest.mark.parametrize(("least", "most", "cell", "kind"), [(2, 7, 50, "long"), (3, 7, 20, "string"), (4, 9, 1000, "long"), (3, 30, 40, "long")])
def test_subsets_find_the_pairs_of_all_cells(spark, monkeypatch, least, most, cell, kind):
    """Cells of one part and of two, sets that are alike in both, sets of so many keys that all pairs are looked at."""
    for name, value in (("WORTH", 0), ("SETS", cell)):
        monkeypatch.setattr(subsets, name, value)
    monkeypatch.setattr(overlap, "ENTRIES", 10**9)
    rng = np.random.default_rng(7)
    sets = [rng.choice(70 if most < 30 else 35, size=rng.integers(1, most), replace=False) for _ in range(400)]
    sets += sets[:60] + sets[:9] + [sets[0]] * 30
    as_kind = {"long": int, "string": str}[kind]
    rows = spark.createDataFrame([(as_kind(i), int(k)) for i, own in enumerate(sets) for k in own], f"item {kind}, key long")
    got = sorted(map(tuple, overlap.overlapping(rows, "item", "key", least).collect()))
    assert got == sorted((*sorted(map(as_kind, pair)), n) for pair, n in _shared(sets, least).items())


def test_pairs_of_subsets_are_sent_in_pieces(monkeypatch):
    monkeypatch.setattr(subsets, "PIECE", 7)
    assert [list(zip(*map(list, x), strict=True)) for x in subsets._pieces(np.array([0, 3, 0, 9, 1, 0]), 7)] == [[(1, 0), (1, 1), (1, 2), (3, 0), (3, 1), (3, 2), (3, 3)], [(3, 4), (3, 5), (3, 6), (3, 7), (3, 8), (4, 0)]]
    keys = [[1, 2, 3]] * 5 + [[1, 2, 3, 4]] * 4 + [[1, 3, 4], [1, 4]]
    rows = pa.record_batch([pa.array([1] * 11, pa.int64()), *[pa.array([0] * 11, pa.int32())] * 3, pa.array(range(11)), pa.array(keys, pa.list_(pa.int32()))], ["rank", "low", "high", "part", "item", "keys"])
    sent = list(subsets.met(iter([rows.slice(0, 4), rows.slice(4)]), 4, 3))
    assert max(map(len, sent)) <= 7
    assert {(min(r["x"], r["y"]), max(r["x"], r["y"])): r["weight"] for b in sent for r in b.to_pylist()} == _shared(keys, 3) and sum(map(len, sent)) == len(_shared(keys, 3))


def test_a_long_list_of_an_index_is_read_by_entries(spark, tmp_path):
    """Lists over many blocks, also one that starts at a block's end: an entry is a row, and nothing is ranged by its place."""
    nasty = ["a,b", 'say "x, y"', "[{", "}]", "back\\slash,", "é,日", '\\",', "{ plain"]
    index = {'first "k,': [nasty[i % 8] if i % 2 else {"url": f"u{i}", "text": nasty[i % 7]} for i in range(900)], "none": [], "word": "x", "object": {"a": 1, "b": 2}}
    index |= {f"k{i}": [f"p{i}", {"url": nasty[i % 8]}, None] for i in range(200)} | {"last": [f"q{i}" for i in range(500)]}
    want = {(k, at, x["url"] if isinstance(x, dict) else x, x.get("text") if isinstance(x, dict) else None) for k, own in index.items() if isinstance(own, list) for at, x in enumerate(own)}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/lines.json").write_text("\n" + json.dumps({f"l {k}": v for k, v in index.items()}, indent=1) + "\n", encoding="utf-8")
    (tmp_path / "a/line.json").write_text(json.dumps(index, ensure_ascii=False), encoding="utf-8")
    with storage.conf(spark, {"spark.sql.files.maxPartitionBytes": "1500"}):
        posted = files.keyword_index(spark, str(tmp_path / "a"))
        got = [(r.keyword, r.position, r.url, r.text) for r in posted.collect()]
    assert len(got) == len(set(got)) == 2 * len(want)
    assert set(got) == want | {(f"l {k}", *x) for k, *x in want}
    assert "repartitionbyrange" not in posted._jdf.queryExecution().executedPlan().toString().lower()


def test_documents_are_written_by_rows(spark, tmp_path, monkeypatch):
    """A document's rows are lines of its file: none holds all of them."""
    monkeypatch.setattr(layouts, "shared_folder", lambda s: str(tmp_path / "out"))
    catalog.QUERIES["keyword_index_files"](spark, DATA)
    found = spark.read.text(str(tmp_path / "out"))
    assert found.count() == entities.postings(spark, DATA).count() and found.agg(F.max(F.length("value"))).first()[0] < 200
    whole = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert len({k for r in whole for k in json.loads(r.value)}) == len(whole) == 25


def test_queue_state_is_summed_without_python(spark, tmp_path):
    """The queue's stream sums urls by built-in state; the stream of changes with timers gives the same last statuses."""
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("minute") * 60)
    rows = [("a", "failed", 0), ("a", "failed", 30), ("b", "failed", 95), ("c", "found", 5), ("d", "failed", 1), ("d", "done", 2), (None, "failed", 3), ("e", None, 4), ("f", "failed", None), *(("g", "failed", i) for i in range(3)), ("c", "found", 100)]
    events = spark.createDataFrame(rows, "url string, kind string, minute int").select("url", "kind", at.alias("at"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = queue.run_queue(stream, str(tmp_path / "out"), str(tmp_path / "check"), wait_ms=30 * 60_000)
    want = {"a": ("pending", 2), "b": ("waiting", 1), "c": ("pending", 0), "d": ("done", 1), "f": ("pending", 1), "g": ("dead", 3)}
    assert {r.url: (r.status, r.failures) for r in got.collect()} == want
    state = next((tmp_path / "check/state/0").iterdir(), None)
    assert state is not None and not (tmp_path / "check/state/0/_stateSchema").exists()
    changes: dict = {}
    with storage.conf(spark, incremental.STATE):
        queue.queue_stream(stream, wait_ms=30 * 60_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).foreachBatch(lambda df, n: changes.update({r.url: (r.status, r.failures) for r in df.collect()})).start().awaitTermination()
    assert changes == want
