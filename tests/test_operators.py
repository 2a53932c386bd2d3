"""Hand cases, published decodings and edge cases of the library's operators."""

from __future__ import annotations

import datetime as dt
import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion import schemas
from quarrion.functions import decode as D
from quarrion.functions import extract as X
from quarrion.functions import gazetteer
from quarrion.functions import signal as S
from quarrion.functions import text as C
from quarrion.functions.geo import haversine, region
from quarrion.operators import bibliography, geo, graph, labelling, overlap, ranking, search, timeseries, topics
from quarrion.operators import signal as Z
from quarrion.operators.cooccurrence import pair_counts
from quarrion.operators.numbering import numbered
from quarrion.operators.overlap import overlapping
from quarrion.sources import files, pages, sinks
from quarrion.streaming import incremental

ROOT = Path(__file__).resolve().parent.parent


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Published decodings (code, tagged, method, lat, lon, region, facility, km, anomaly, km).
DECODED = (
    ("+070-022", True, "dsp", 36.231, -118.7034, "North America", "China Lake NAWS", 109.3, "Bermuda Triangle", 4683.3),
    ("+007+209", False, "small", 28.0, 52.25, "Africa/Middle East", "Mecca", 1450.4, "Kursk Magnetic Anomaly", 2908.0),
    ("-177+331", False, "large", 33.1, -17.7, "Africa/Middle East", "Mecca", 5761.8, "Bangui Anomaly", 4837.6),
    ("+506-321", False, "large", -32.1, 50.6, "Southern Africa", "Mecca", 6061.6, "SAA African Lobe", 3267.0),
    ("+023+170", False, "small", 44.0, 42.5, "Central Asia", "Dushanbe", 2266.2, "Kursk Magnetic Anomaly", 933.4),
    ("+055+221", False, "small", 76.0, 55.25, "Arctic", "Dushanbe", 4217.8, "Kursk Magnetic Anomaly", 2810.5),
)


def test_decoded_places(spark):
    rows = spark.createDataFrame([(c, "MilDSP" if t else "") for c, t, *_ in DECODED], "code string, context string")
    v1, v2 = D.parse_code(F.col("code"))
    rows = rows.withColumn("p", D.decode(v1, v2, F.col("context"))).select("code", "p.*")
    rows = geo.nearest_site(geo.nearest_site(rows, gazetteer.sites(spark), "facility"), gazetteer.sites(spark, "anomaly"), "anomaly")
    got = {r.code: r for r in rows.withColumn("region", region(F.col("lat"), F.col("lon"))).collect()}
    for code, _, method, lat, lon, where, facility, f_km, anomaly, a_km in DECODED:
        r = got[code]
        assert (r.method, r.region, r.nearest_facility, r.nearest_anomaly) == (method, where, facility, anomaly)
        assert (r.lat, r.lon) == pytest.approx((lat, lon), abs=1e-3)
        assert (r.facility_km, r.anomaly_km) == pytest.approx((f_km, a_km), abs=0.06)


@pytest.mark.parametrize(("code", "hours", "dec"), [("+003-261", 0.05, -26.1), ("+103-202", 1.05, -20.2), ("+005-438", 0.0833, -43.8), ("+005+407", 0.0833, 40.7)])
def test_celestial(spark, code, hours, dec):
    v1, v2 = D.parse_code(F.lit(code))
    p = one(spark, D.decode(v1, v2, F.lit("milDSP note")))
    assert p.is_celestial and (p.lon, p.lat) == pytest.approx((hours, dec), abs=1e-3)


def test_codes_in_text(spark):
    text = "DASYS 2075-05-25 and MeKG-6-30-15, but after a long stretch of plain words and more of them +007+209 stands; and then again many words before MilOrb -11-03 too"
    found = one(spark, D.codes_in(F.lit(text)))
    assert [c.code for c in found] == ["+007+209", "-11-03"]
    assert one(spark, D.codes_in(F.lit("no codes"))) == []


def test_text_functions(spark):
    assert one(spark, C.month_from_url(F.lit("/2017/12/a.html"))) == "2017-12"
    assert one(spark, C.month_from_url(F.lit("/a/b"))) is None
    for text, year in (("2004", 2004), ("2004.0", 2004), ("2004a", None), ("c. 1998", 1998), ("999", None), ("2031", None)):
        assert one(spark, C.clean_year(F.lit(text))) == year
    assert one(spark, C.tag_terms(F.lit("an UNDER cover"), ["nde", "cover"])) == ["nde", "cover"]
    assert one(spark, C.tag_terms(F.lit("an UNDER cover"), ["nde", "cover"], mode="token")) == ["cover"]
    assert one(spark, C.ascii_ratio(F.lit(""))) is None
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, C.highlight(F.lit("a.B a.b"), "a.b")) == "<mark>a.B</mark> <mark>a.b</mark>"
    assert one(spark, C.html_escape(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(spark, C.fenced_json(F.lit('x ```json\n{"a":1}\n``` y'))) == '{"a":1}'
    assert one(spark, C.references(F.lit("fl-01/02/03 FL123456"), broad=True)) == ["fl-01/02/03", "FL123456"]
    assert [(m.start, m.text) for m in one(spark, C.matches_at(F.lit("é12 345"), r"\d+"))] == [(1, "12"), (4, "345")]


def test_extraction(spark):
    cited = one(spark, X.citations(F.lit("Smith et al. (2004), Smith et al. (2004); see (Jones, 1999a)")))
    assert [(c.type, c.author, c.year) for c in cited] == [("author_year", "Smith et al.", "2004"), ("parenthetical_comma", "Jones", "1999a")]
    text = 'Intro.\n\nReferences\n\nSmith, J. (2004). "A Title". Nature Letters 12(3-9). 10.1000/xyz https://e.org/a\n\nNo year here at all, sorry'
    lines = one(spark, X.bibliography_lines(F.lit(text)))
    assert len(lines) == 1
    entry = one(spark, X.bibliography_entry(F.lit(lines[0])))
    assert (entry.author, entry.year, entry.title, entry.volume, entry.pages, entry.doi, entry.url) == ("Smith, J", "2004", "A Title", "12", "3-9", "10.1000/xyz", "https://e.org/a")
    assert one(spark, X.contained_once(F.array(*map(F.lit, ("abc", "abcd", "x"))))) == ["abc", "x"]
    html = '<figure><img src="/a/header.png" width="100" height="80" alt="A"><img src="//h/x.jpg" width="10" height="10"><img src="b.gif"><img src="b.gif"><img src="logo.svg"></figure>'
    images = one(spark, X.image_rows(F.lit(html), "https://s.org/p/q.html"))
    assert [(i.url, i.file_type, i.is_header, i.position) for i in images] == [("https://s.org/a/header.png", "png", 1, 0), ("https://s.org/p/b.gif", "gif", 0, 2)]
    kinds = one(spark, X.excerpts(F.lit('He said "this is a quoted text of some length" and *this is a very much stressed part of it*.'), ["Zeta"]))
    assert [k.category for k in kinds][:2] == ["quote", "emphasis"]
    assert one(spark, X.lat_lon(F.lit("1.5, -2"))).lon == -2 and one(spark, X.lat_lon(F.lit("x, 1"))) is None
    assert one(spark, X.page_title(F.lit("<title>Site: A  b</title>"), "Site: ")) == "A b"
    assert one(spark, X.page_labels(F.lit('<a href="x" rel="tag">L 1</a><a>no</a>'))) == ["L 1"]
    assert one(spark, X.markdown_meta(F.lit("### [T]\n## May 3, 2020"))).date == "May 3, 2020"
    assert one(spark, X.coordinate_mentions(F.lit("12.345, -45.678 and +012-345"))) == ["+012-345", "12.345, -45.678"]


def test_series(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 5),), (dt.date(2020, 1, 9),), (dt.date(2020, 4, 1),), (None,)], "ts date")
    filled = timeseries.gap_filled(timeseries.monthly_counts(rows, "ts"))
    assert [r.value for r in filled.orderBy("period").collect()] == [2, 0, 0, 1]
    z = timeseries.bursts(spark.createDataFrame([(dt.date(2020, m, 1), 5) for m in range(1, 6)], "period date, value long")).orderBy("period").collect()
    assert [r.z for r in z] == [None, None, 0, 0, 0] and not any(r.is_burst for r in z)
    dated = spark.createDataFrame([("new", dt.date(2021, 1, 1)), ("old", dt.date(2015, 1, 1))], "k string, period date")
    trends = {r.k: r.ratio for r in timeseries.trend_ratio(dated, "k").collect()}
    assert trends == {"new": 999.0, "old": 0.0}
    empty = spark.createDataFrame([], "ts date")
    series = timeseries.gap_filled(timeseries.monthly_counts(empty, "ts"))
    for f in (timeseries.bursts, timeseries.autocorrelation, timeseries.periodogram, timeseries.seasonality, timeseries.year_month_pivot):
        assert f(series).count() == 0
    values = np.random.default_rng(1).integers(0, 50, 40)
    power = timeseries.periodogram(spark.createDataFrame([(dt.date(2000 + i // 12, i % 12 + 1, 1), int(v)) for i, v in enumerate(values)], "period date, value long"))
    t = np.arange(40)
    flat = values - np.polyval(np.polyfit(t, values, 1), t)
    want = np.abs(np.fft.rfft(flat))[1:] ** 2
    assert [r.power for r in power.orderBy("k").collect()] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_close_pairs_over_the_whole_globe(spark):
    random = np.random.default_rng(5)
    points = [(i, float(lat), float(lon)) for i, (lat, lon) in enumerate(zip(np.degrees(np.arcsin(random.uniform(-1, 1, 300))), random.uniform(-180, 180, 300), strict=True))]
    points += [(300, 89.9, 10.0), (301, 89.95, -170.0), (302, 10.0, 179.9), (303, 10.1, -179.9), (304, -90.0, 0.0), (305, -89.8, 120.0), (306, 1.0, 180.0), (307, 1.0, -180.0)]
    rows = spark.createDataFrame(points, "id int, lat double, lon double")
    got = {(r.a, r.b) for r in geo.close_pairs(rows, 400).collect()}
    far = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    want = {(r[0], r[1]) for r in rows.alias("a").crossJoin(rows.alias("b")).filter("a.id < b.id").filter(far < 400).select("a.id", "b.id").collect()}
    assert got == want and (300, 301) in got and (302, 303) in got and (306, 307) in got
    found = geo.nearest_site(rows.limit(0), gazetteer.sites(spark), "site")
    assert found.count() == 0


def test_many_sites_are_found_at_any_distance(spark):
    """One site more than travels as an array: the same result as with one, also from the other side of the globe."""
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, -170.0), (3, 10.0, 13.0), (3, 10.0, 13.0), (4, None, 1.0)], "id int, lat double, lon double")
    one = spark.createDataFrame([(10.0, 10.0, 0, "s0")], "lat double, lon double, ord long, name string")
    many = spark.range(geo.MOST_SITES + 1).select(F.lit(10.0).alias("lat"), F.lit(10.0).alias("lon"), F.col("id").alias("ord"), F.concat(F.lit("s"), F.col("id")).alias("name"))
    got, want = ([tuple(r) for r in geo.nearest_site(points, s).orderBy("id").collect()] for s in (many, one))
    assert got == want and got[1][3] == "s0" and got[1][4] > 19_000 and got[4][3] is None


def test_graphs(spark):
    star = spark.createDataFrame([("c", "x", 1), ("c", "y", 1), ("c", "z", 1)], "a string, b string, weight long")
    scores = {r.node: r.bridge_score for r in graph.bridge_scores(star).collect()}
    assert scores == {"c": 1.0}
    triangle = spark.createDataFrame([("a", "b", 4), ("a", "c", 9), ("b", "c", 9)], "a string, b string, weight long")
    assert {r.bridge_score for r in graph.bridge_scores(triangle).collect()} == {0.0}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "label string")
    edges = spark.createDataFrame([("a", "b", 4), ("b", "c", 5)], "a string, b string, weight long")
    assert {r.label: r.community for r in graph.communities(nodes, edges).collect()} == {"a": "Other", "b": "b", "c": "b", "d": "Other", "e": "Other"}
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(60) if i != 30], "a int, b int, weight int")
    assert {r.root for r in graph.components(chain).collect()} == {0, 31}
    assert graph.components(chain.limit(0)).count() == 0
    long = spark.createDataFrame([(i, i + 1, 1) for i in range(500)], "a int, b int, weight int")
    assert {tuple(r) for r in graph.components(long).collect()} == {(i, 0) for i in range(501)}
    assert {r.bridge_score for r in graph.bridge_scores(triangle, max_neighbors=None).collect()} == {0.0}
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b")], "g int, x string")
    assert [tuple(r) for r in pair_counts(rows, "g", "x").collect()] == [("a", "b", 2)]
    posted = spark.createDataFrame([(1, "k"), (2, "k"), (2, "m"), (3, "m"), (4, "n")], "url int, keyword string")
    assert [tuple(r) for r in graph.reading_path(posted, 1).orderBy("depth", "url").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_ranking(spark):
    rows = spark.createDataFrame([(f"u{i}", 100.0 - i, c) for i, c in enumerate("aaaaaab")], "url string, score double, category string")
    assert [r.url for r in ranking.diverse(rows, "category").collect()] == ["u0", "u1", "u2", "u3", "u4", "u6"]
    tiers = ranking.reading_order(spark.createDataFrame([(f"u{i}", float(i)) for i in range(10)], "url string, score double"))
    assert {r.difficulty: r["count"] for r in tiers.groupBy("difficulty").count().collect()} == {"beginner": 2, "intermediate": 4, "advanced": 4}
    assert search.first_rows(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string"), ["k"], ["o"]).first().v == "a"


def test_noise_and_fields(spark):
    reason = bibliography.noise_reason
    assert one(spark, reason(F.repeat(F.lit("x"), 51), F.lit("dys yr eid"))) == "author_too_long"
    assert one(spark, reason(F.lit("A"), F.lit("dys yr eid"))) == "fl_language_patterns"
    assert one(spark, reason(F.lit("dys yr"), F.lit(""))) == "fl_author_patterns"
    assert one(spark, reason(F.lit(None).cast("string"), F.repeat(F.lit("word "), 120))) == "unstructured_long_text"
    assert one(spark, reason(F.lit("A"), F.lit("fine"))) is None
    fields = {"One": ("a", "b"), "Two": ("b", "c")}
    assert [one(spark, bibliography.field_of(F.lit(t), fields)) for t in ("b", "bc", "z")] == ["One", "Two", "Other"]


def test_families(spark):
    rows = spark.createDataFrame([("x", "t1", 9), ("y", "t1", 8), ("z", "t2", 7), ("w", "t2", 1)], "k string, t string, n int")
    got = {r.k: r.family for r in labelling.families(rows, "k", "t", "n").collect()}
    assert got == {"x": 0, "y": 0, "z": 1}
    assert labelling.families(rows.limit(0), "k", "t", "n").count() == 0


def test_topic_model_finds_blocks(spark):
    docs = [(i, " ".join(("red green blue" if i % 2 else "dog cat bird").split() * 4)) for i in range(40)]
    weights = topics.tfidf(spark.createDataFrame(docs, "doc_id long, text string"))
    doc_topics, terms = topics.nmf(weights, topics=2, rounds=15)
    best = {r.doc_id: r.topic for r in topics.dominant(doc_topics).collect()}
    assert len({best[i] for i in range(0, 40, 2)}) == len({best[i] for i in range(1, 40, 2)}) == 1 and best[0] != best[1]
    names = {r.topic: set(r.name.split("-")) for r in topics.topic_names(terms).collect()}
    assert names[best[1]] == {"red", "green", "blue"}


def test_signals(spark):
    assert S.morse_text("... --- ... / .-") == "SOS A" and S.morse_text(".......") == "[.......]"
    assert one(spark, Z.morse_decoded(F.lit("... --- ... / .- ......."))) == "SOS A[.......]"
    rate, t = 8000, np.arange(8000) / 8000
    tone = np.sin(2 * np.pi * 1000 * t)
    assert S.envelope(tone, rate)[500:-500] == pytest.approx(1.0, abs=0.02)
    assert abs(S.fm_deviation(tone, rate, 1000)[100:-100]).max() < 1
    assert S.band_ratios(tone, rate, ((900, 1100), (2000, 3000)))[0] > 0.99
    assert np.abs(S.band_pass(tone, rate, 2000, 3000)).max() < 0.01
    flipped = np.where(t < 0.5, 1, -1) * tone
    assert any(abs(j - 4000) < 40 for j in S.psk_jumps(flipped, rate, 1000, least=0.05))
    assert S.ascii_from_bits(np.unpackbits(np.frombuffer(b"Hi", np.uint8))) == "Hi"
    unit, symbols = 0.06, "... --- ..."
    on: list[float] = []
    for s in symbols:
        on += [0.0] * int(2 * unit * rate) if s == " " else [1.0] * int((3 if s == "-" else 1) * unit * rate) + [0.0] * int(unit * rate)
    keyed = np.array(on) * np.sin(2 * np.pi * 1000 * np.arange(len(on)) / rate)
    # The letter gap is three units; a smoothed edge makes it somewhat shorter or longer.
    clips = spark.createDataFrame([(1, rate, [0.0] * 400 + keyed.tolist() + [0.0] * 400)], "clip int, rate int, samples array<double>")
    texts = {r.text.replace(" ", "") for r in Z.morse(clips, ((800, 1200),)).collect()}
    assert any("SOS" in x or "...---..." in x for x in texts), texts
    assert Z.per_clip(clips.limit(0), lambda x, r: {"n": len(x)}, "n int").count() == 0
    assert Z.segments(clips, seconds=1).count() == int(np.ceil((len(keyed) + 800) / rate))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('URL,Title,Date,Excerpt,Word Count\nhttp://x/2017/12/a,T,,"see FL-010203, yes",\n')
    row = files.excerpts(spark, str(tmp_path / "a.csv"), ["yes"]).first()
    assert (row.date, row.word_count, row.keywords, row.refs) == ("2017-12", 3, ["yes"], ["FL-010203"])
    assert files.excerpts(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "k.json").write_text(json.dumps({"a": [{"url": "u1", "text": "t"}, "u2"], "b": []}))
    assert sorted((r.keyword, r.url, r.text) for r in files.keyword_index(spark, str(tmp_path / "k.json")).collect()) == [("a", "u1", "t"), ("a", "u2", None)]
    (tmp_path / "art.json").write_text(json.dumps([{"url": "u", "date": "2020-13", "labels": ["x"]}, {"url": "v", "date": "2020-05"}]))
    assert [r.month for r in files.articles(spark, str(tmp_path / "art.json")).orderBy("url").collect()] == [None, dt.date(2020, 5, 1)]
    (tmp_path / "c.csv").write_text("lat,lon,type,date,title,raw\n1.5,2,d,x,y,z\nbad,2,d,x,y,z\n")
    assert files.coordinates(spark, str(tmp_path / "c.csv")).count() == 1
    (tmp_path / "s.json").write_text(json.dumps({"total_articles": 2, "top_labels": {"a": 1}}))
    assert files.statistics(spark, str(tmp_path / "s.json")).first().top_labels == {"a": 1}
    (tmp_path / "u.txt").write_text("# c\n\nhttp://a\n http://b \n")
    assert files.url_list(spark, str(tmp_path / "u.txt")).count() == 2
    links = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1")], "url string, older string")
    assert files.crawl(links, ["p1"], 5).count() == 3
    long = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(1, 7)], "url string, older string")
    listed = spark.createDataFrame([("p1", "a"), ("p3", "new"), ("p4", "b")], "url string, article string")
    known = spark.createDataFrame([("a",), ("b",)], "article string")
    assert {r.url for r in files.crawl(long, ["p1"], 9, listed, known).collect()} == {"p1", "p2", "p3", "p4"}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.jsonl").write_text(json.dumps({"url": "u", "status": 200, "html": "<p>"}) + "\n")
    pages.register(spark)
    assert spark.read.format("pages").option("path", str(tmp_path / "pages")).load().first().html == "<p>"
    assert schemas.empty(spark, schemas.IMAGES).count() == 0


def test_audio(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, 300], [0, 0]], "<i2").tobytes())
    row = files.audio(spark, str(tmp_path)).first()
    assert row.rate == 8000 and row.samples == pytest.approx([200 / 32768, 0])


def test_sinks(spark, tmp_path):
    points = spark.createDataFrame([(1, 2.5, 3.5)], "id int, lat double, lon double")
    document = json.loads(sinks.geojson(points, ["id"]).first().document)
    assert document["features"][0]["geometry"]["coordinates"] == [3.5, 2.5]
    assert not sinks.csv(points.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.csv(points, str(tmp_path / "some"))
    both = json.loads(sinks.network(points, points).first().document)
    assert both["metadata"]["total_nodes"] == 1
    articles = spark.createDataFrame([(1, "u"), (2, "v")], "article_id int, url string")
    images = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "article_id int, position int, src string")
    nested = {r.article_id: json.loads(r.document) for r in sinks.nested_articles(articles, images=images).collect()}
    assert [i["src"] for i in nested[1]["images"]] == ["a", "b"] and nested[2]["images"] == []
    quoted = sinks.download_script(spark.createDataFrame([("http://h/a'; rm x #.png",)], "image_url string")).first().script
    assert "'http://h/a'\\''; rm x #.png'" in quoted
    script = sinks.download_script(spark.createDataFrame([("http://h/a.png",)], "image_url string")).first().script
    assert script == "curl -L -o 'a.png' 'http://h/a.png'"
    assert sinks.saved(points, str(tmp_path / "p")).count() == 1


def test_incremental(spark, tmp_path):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string")
    changes = spark.createDataFrame([(2, 1, "B"), (3, 1, "c"), (3, 2, "C")], "id int, v int, x string")
    assert sorted(map(tuple, incremental.upserted(base, changes, ["id"], "v").collect())) == [(1, 1, "a"), (2, 1, "B"), (3, 2, "C")]
    assert incremental.appended(base, changes, ["id"]).count() == 3
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    base.write.parquet(source)
    incremental.ingest(spark, source, "id int, v int, x string", target, check, ["id"], "x != 'a'", files_per_batch=1)
    changes.write.mode("append").parquet(source)
    incremental.ingest(spark, source, "id int, v int, x string", target, check, ["id"], "x != 'a'", files_per_batch=1)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [2, 3]
    assert [r.x for r in spark.read.parquet(target + "_failed").collect()] == ["a"]
    assert spark.read.json(target + "_log").agg(F.sum("rows")).first()[0] == 5


def test_search_helpers(spark):
    rows = spark.createDataFrame([(1.0, "Alpha"), (2.0, None)], "lat double, title string")
    assert search.renamed(rows, {"lat": "latitude", "none": "x", "title": "lat"}).columns == ["latitude", "title"]
    assert search.any_column(rows, "ALPHA").count() == 1
    assert search.search(rows, "alp", text="title").count() == 1
    assert search.top_per_group(rows.withColumn("g", F.lit(1)), ["g"], [F.desc("lat")], 1).first().lat == 2.0
    kinds = rows.select(search.bucketed(F.col("title"), {"A": ("Alpha",)}).alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["A", "Other"]


def test_articles_and_trends(spark):
    assigned = spark.createDataFrame([("u", 0, 1, 0.9), ("u", 1, 2, 0.2), ("v", 0, 1, 0.9), ("w", 0, 1, 0.4)], "url string, position int, topic int, score double")
    labels = spark.createDataFrame([("u", "a"), ("v", "b"), ("w", "a"), ("x", "a")], "url string, label string")
    aligned = spark.createDataFrame([(1, "a", 0.7)], "topic int, label string, share double")
    assert [r.url for r in topics.mislabelled(assigned, labels, aligned).collect()] == ["v"]
    best = {(r.topic, r.label): r.share for r in topics.alignment(assigned, labels).collect()}
    assert best[1, "a"] == pytest.approx(2 / 3)
    dated = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1)), (1, "b", dt.date(2022, 1, 1)), (1, "d", dt.date(2022, 1, 1)), (2, "c", dt.date(2020, 1, 1))], "topic int, url string, month date")
    assert {r.topic: r.direction for r in topics.topic_trends(dated).collect()} == {1: "rising", 2: "declining"}


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    from quarrion import storage

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(session("spark://host:7077", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(session("local-cluster[2,1,1024]", None))
    assert storage.shared_folder(session("local[4]", None)).startswith("file:/")
    assert storage.shared_folder(session("spark://host:7077", "hdfs://x/y/")).startswith("hdfs://x/y/")


def test_operators_ship_the_package(tmp_path):
    """From a folder without the package on any path of the executors."""
    script = tmp_path / "own.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from quarrion.operators.signal import band_energy, envelopes
clips = spark.createDataFrame([(1, 8000, [float(i % 7) for i in range(800)])], "clip int, rate int, samples array<float>")
assert envelopes(clips, 100.0, 900.0).count() == 1
print("shipped")
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "shipped" in done.stdout, done.stderr[-2000:]


def test_family_summary(spark):
    members = spark.createDataFrame([(f"k{i:02}", 0) for i in range(12)] + [("z", 1)], "k string, family int")
    matrix = spark.createDataFrame([("k00", t, n) for t, n in (("a", 5), ("b", 7), ("c", 5), ("d", 1))] + [("k01", "a", 1)], "k string, t string, n long")
    articles = spark.createDataFrame([("k00", 9), ("z", 2)], "k string, article_count long")
    got = {r.family: r for r in labelling.family_summary(members, matrix, articles, "k", "t", "n").collect()}
    assert got[0].members == ", ".join(f"k{i:02}" for i in range(10)) + " (+2 more)"
    assert got[0].primary_topics == "b (7), a (6), c (5)" and got[0].article_count == 9
    assert got[1].members == "z" and got[1].primary_topics == "" and got[1].article_count == 2


def test_spoken_excerpts(spark):
    text = 'x "one two three four five six\nseven" *one two three four five six seven eight* The A+B is what we all saw here with them today. No A+B here.'
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.spoken_excerpts(F.col("t"), ("A+B",)).alias("e")).collect()
    assert [(e.text, e.words) for e in got[0].e] == [("one two three four five six seven", 7), ("one two three four five six seven eight", 8), ("The A+B is what we all saw here with them today.", 11)]
    assert got[1].e is None and got[2].e == []


def test_work_queue(spark):
    queue = spark.createDataFrame([("a", "done"), ("b", "pending")], "url string, status string")
    grown = incremental.queued(queue, spark.createDataFrame([("a",), ("c",), ("c",)], "url string"))
    assert {tuple(r) for r in grown.collect()} == {("a", "done"), ("b", "pending"), ("c", "pending")}
    assert {tuple(r) for r in incremental.finished(grown, spark.createDataFrame([("c",)], "url string")).collect()} == {("a", "done"), ("b", "pending"), ("c", "done")}


def test_numbered(spark):
    """Places over several ranges equal those of one window; hot, null and repeated keys, clashing names, an empty table."""
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("id"), F.lit("x").alias("rows"), F.lit(1).alias("a.b"))
    order = [F.desc("k"), F.asc_nulls_last("id")]
    got = [(r.k, r.id) for r in numbered(rows.repartition(7), order).orderBy("n").collect()]
    assert got == [(r.k, r.id) for r in rows.orderBy(*order).collect()]
    places = numbered(rows, order).select("n").collect()
    assert sorted(r.n for r in places) == list(range(1, 5001))
    assert numbered(rows.limit(0), order).count() == 0 and numbered(rows, order).columns == [*rows.columns, "n"]
    with pytest.raises(ValueError):
        numbered(rows, order, "k")
    plan = numbered(rows, order)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("BroadcastExchange")[0]


def brute_overlaps(rows, least):
    sets: dict = {}
    for item, key in rows:
        if item is not None and key is not None:
            sets.setdefault(item, set()).add(key)
    return sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least)


@pytest.mark.parametrize(("least", "cell"), [(1, 1000), (2, 1000), (2, 3), (4, 7)])
def test_overlapping_sets(spark, least, cell):
    """Against all pairs: common and rare keys, hot lists in cells, nulls and repeated rows."""
    rng = np.random.default_rng(least)
    rows = [(int(i), f"k{min(29, int(rng.exponential(6)))}") for i in rng.integers(0, 120, 900)]
    rows += [(i, "hot") for i in range(0, 120, 2)] + [(None, "k1"), (3, None), (500, "alone"), (501, "k1"), *rows[:20]]
    df = spark.createDataFrame(rows, "url long, keyword string")
    got = sorted(map(tuple, overlapping(df, "url", "keyword", least, cell).collect()))
    assert got == brute_overlaps(rows, least) and len(got) > 20
    assert overlapping(df.limit(0), "url", "keyword", least).count() == 0


def test_a_hot_key_is_not_squared(spark):
    """A key of all 60,000 sets, beside rarer ones, is in no prefix; the join's rows stay far below its square."""
    df = spark.range(60_000).select(F.col("id").alias("url"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("k"), (F.col("id") / 3).cast("long")))).alias("keyword"))
    assert overlapping(df, "url", "keyword", 2).count() == 60_000


def test_long_lists_are_dealt_to_cells(spark):
    prefixes = spark.range(100).select(F.col("id").alias("item"), F.array(F.lit(1)).alias("keys"), F.lit(0).alias("at"), F.when(F.col("id") < 90, 1).otherwise(2).alias("rank"))
    dealt = overlap._cells(prefixes, 10)
    sizes = dealt.groupBy("rank", "low", "high").count().collect()
    assert len([r for r in sizes if r["rank"] == 1]) == 9 * 10 // 2 and max(r["count"] for r in sizes) < 60
    meet = dealt.alias("x").join(dealt.alias("y"), ["rank", "low", "high"]).filter("x.item < y.item and (low = high or x.part != y.part)").select("x.item", "y.item")
    assert meet.count() == meet.distinct().count() == 90 * 89 // 2 + 10 * 9 // 2


def test_triangles(spark):
    """Against all triples; a hub of 100,000 neighbours makes no wedge."""
    rng = np.random.default_rng(4)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, (150, 2)) if a != b}
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(5, 5, 1)], "a long, b long, weight long")
    want: dict = {}
    for a, b in pairs:
        for c in range(b + 1, 30):
            if (b, c) in pairs and (a, c) in pairs:
                for x in (a, b, c):
                    want[x] = want.get(x, 0) + 1
    assert {r.node: r.triangles for r in graph.triangles(edges).collect()} == want
    capped, exact = (graph.bridge_scores(edges.filter("a != b"), n).orderBy("node").collect() for n in (1000, None))
    assert [tuple(r) for r in capped] == [tuple(r) for r in exact]
    ring = spark.range(1, 100_001).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), (F.col("id") % 100_000 + 1).alias("b")))).alias("e"))
    wheel = ring.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), F.lit(1).alias("weight"))
    hub = graph.bridge_scores(wheel, max_neighbors=None).filter("node = 0").first()
    assert (hub.degree, hub.pairs) == (100_000, 100_000 * 99_999 // 2) and hub.bridge_score == pytest.approx(1 - 100_000 / hub.pairs)


@pytest.mark.parametrize("kind", ["spread", "far", "poles", "ring", "same"])
def test_nearest_site_by_cells(spark, monkeypatch, kind):
    """Against all pairs: sites spread out, far off, at the poles and the date line, on a ring around a point, at one spot."""
    rng = np.random.default_rng(3)
    n = 600
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    p_lat, p_lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 120))), rng.uniform(-180, 180, 120)
    if kind == "far":
        lat, lon, p_lat, p_lon = 40 + rng.normal(0, 0.5, n), -100 + rng.normal(0, 0.5, n), -35 + rng.normal(0, 2, 120), 80 + rng.normal(0, 2, 120)
    elif kind == "poles":
        lat, lon, p_lat, p_lon = rng.choice([90, -90, 89.9, -89.99, 0], n), rng.choice([180, -180, 179.99, -179.9, 0], n) + rng.normal(0, 0.01, n), rng.choice([90.0, -90.0, 89.0], 120), rng.uniform(-180, 180, 120)
        lon = np.clip(lon, -180, 180)
    elif kind == "ring":
        lat, lon, p_lat = np.full(n, 80.0), np.linspace(-180, 179, n), np.full(120, 90.0)
    elif kind == "same":
        lat, lon = np.full(n, 12.5), np.full(n, -33.25)
    sites = spark.createDataFrame([(float(a), float(b), i, f"s{i:04}") for i, (a, b) in enumerate(zip(lat, lon, strict=True))] + [(None, 1.0, -1, "nowhere")], "lat double, lon double, ord long, name string")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p_lat, p_lon, strict=True))] * 2 + [(-1, None, 3.0)], "id long, lat double, lon double")
    want = {r.id: (r.nearest_site, r.site_km) for r in geo.nearest_site(points, sites.filter("lat is not null")).collect()}
    monkeypatch.setattr(geo, "MOST_SITES", 10)
    monkeypatch.setattr(geo, "LEAF_SITES", 4)
    got = geo.nearest_site(points, sites).collect()
    assert len(got) == points.count()
    for r in got:
        assert r.site_km == pytest.approx(want[r.id][1], abs=1e-6), r
        assert r.nearest_site == want[r.id][0] or kind in ("poles", "ring")


def test_far_points_meet_few_sites(spark):
    """Points an ocean away from 20,000 sites keep a few of their cells; the pairs that are left are far fewer than all."""
    sites = spark.range(20_000).select((40 + F.randn(1)).alias("lat"), (-100 + F.randn(2)).alias("lon"), F.col("id").alias("ord"), F.col("id").cast("string").alias("name"))
    points = spark.range(1500).select("id", (-35 + F.randn(3)).alias("lat"), (80 + F.randn(4)).alias("lon"))
    assert geo.nearest_site(points, sites).filter("site_km > 5000").count() == 1500
    tree, placed = geo.site_cells(sites)
    assert tree.filter("leaf").agg(F.sum("n")).first()[0] == placed.count() == 20_000
    assert tree.filter("leaf").agg(F.max("n")).first()[0] <= geo.LEAF_SITES
