"""Incremental, streaming, signal and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.functions.geo import region
from quarrion.operators import signal as Z
from quarrion.plans import entities as E
from quarrion.plans import spatial
from quarrion.plans.registry import Registry
from quarrion.sources import files, sinks
from quarrion.storage import shared_folder
from quarrion.streaming import incremental as I
from quarrion.streaming import queue as Q

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: Clips that one task makes and works on, about.
TASK_CLIPS = 250


def _events(spark, sf_dir):
    return E.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_SPLIT = "cut as (select quantile_disc(event_id, 0.8) as c from events), base as (select * from events, cut where event_id <= c), inc as (select * from events, cut where event_id > c)"


def _split(spark, sf_dir):
    rows = _events(spark, sf_dir)
    cut = rows.agg(F.expr("percentile_disc(0.8) within group (order by event_id)").cast("long").alias("c"))
    both = rows.crossJoin(F.broadcast(cut))
    return both.filter("event_id <= c").drop("c"), both.filter("event_id > c").drop("c")


@query(f"with {_SPLIT} select distinct user_id, floor(value / 2)::int as bucket from inc where not exists (select 1 from base where base.user_id = inc.user_id and floor(base.value / 2) = floor(inc.value / 2))")
def new_composite_keys(spark, sf_dir):
    base, more = (x.select("user_id", F.floor(F.col("value") / 2).cast("int").alias("bucket")) for x in _split(spark, sf_dir))
    return I.new_rows(more, base, ["user_id", "bucket"])


@query(f"with {_SPLIT}, joint as (select user_id, event_id, value from base union all select user_id, event_id, value from inc) select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from joint group by 1", rounded="value")
def upserted_users(spark, sf_dir):
    base, more = (x.select("user_id", "event_id", "value") for x in _split(spark, sf_dir))
    return I.upserted(base, more, ["user_id"], "event_id")


@query(f"with {_SPLIT} select event_type as name, count(*) as mention_count, min(event_id) as first_seen from events group by 1")
def entity_counters(spark, sf_dir):
    base, more = (x.select(F.col("event_type").alias("name"), F.col("event_id").alias("first_seen")) for x in _split(spark, sf_dir))
    empty = base.limit(0).withColumn("mention_count", F.lit(0).cast("long"))
    return I.counted(I.counted(empty, base), more)


@query("select distinct x as url from (select 'http://site/' || (o_custkey % 500) as x from orders union all select 'http://site/' || c_custkey from customer)")
def known_urls(spark, sf_dir):
    one = E.table(spark, sf_dir, "orders").select(F.concat(F.lit("http://site/"), F.col("o_custkey") % 500).alias("url"))
    two = E.table(spark, sf_dir, "customer").select(F.concat(F.lit("http://site/"), "c_custkey").alias("url"))
    return files.known_urls(one, two)


@query("select c_custkey as id from customer except select o_custkey from orders where o_totalprice > 250000")
def url_difference(spark, sf_dir):
    known = E.table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("id"))
    return I.new_rows(E.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), known, ["id"])


@query("select c_custkey as url, case when c_custkey in (select o_custkey from orders where o_totalprice > 250000) then 'done' else 'pending' end as status from customer union select distinct o_custkey, case when o_custkey in (select o_custkey from orders where o_totalprice > 250000) then 'done' else 'pending' end from orders")
def work_queue(spark, sf_dir):
    """Customers are queued, then those with orders; the ones with a large order are done."""
    orders = E.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), "o_totalprice")
    first = E.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.lit("pending").alias("status"))
    return I.finished(I.queued(first, orders), orders.filter("o_totalprice > 250000"))


@query("select 'http://site/' || strftime(m, '%Y/%m') as url from (select unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), interval 1 month)) as m from orders)")
def archive_months(spark, sf_dir):
    """An archive page for each month from the first order to the last."""
    ends = E.table(spark, sf_dir, "orders").agg(*(F.date_format(F.trunc(f("o_orderdate"), "MM"), "yyyy-MM-dd") for f in (F.min, F.max))).first()
    return files.archive_urls(spark, "http://site/", *ends)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all", dates="start")
def windowed_event_counts(spark, sf_dir):
    return I.windowed_counts(_events(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _event_files(spark, sf_dir) -> tuple:
    """Schema, folder and file pattern of the events, for a stream."""
    rows = E.table(spark, sf_dir, "events")
    return (rows.schema, sf_dir, "events.parquet") if rows.inputFiles()[0].endswith("/events.parquet") else (rows.schema, f"{sf_dir}/events.parquet", "*.parquet")


@query("select distinct user_id, event_type, value > 50 as big from events where value is not null and event_type <> 'error'")
def ingested_keys(spark, sf_dir):
    """Rows new by their keys, taken by a stream that keeps the keys as its state."""
    schema, folder, pattern = _event_files(spark, sf_dir)
    target = shared_folder(spark)
    I.ingest(spark, folder, schema, target, shared_folder(spark), ["user_id", "event_type", "value"], "value is not null and event_type <> 'error'", pattern=pattern)
    return spark.read.schema(schema).parquet(target).select("user_id", "event_type", (F.col("value") > 50).alias("big")).distinct()


_QUEUE = """e as (select 'http://site/' || user_id || '/' || strftime(ts, '%Y%m%d') as url, epoch_ms(ts) as ms, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'found' end as kind from events),
    p as (select url, bool_or(kind = 'done') as done, count(*) filter (where kind = 'failed')::int as failures, max(ms) filter (where kind = 'failed') as last from e group by 1),
    w as (select max(ms) - 600000 as now from e)"""


def _url_events(rows):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("found")
    at = F.col("ts").cast("timestamp")
    return rows.select(F.concat(F.lit("http://site/"), F.col("user_id"), F.lit("/"), F.date_format(at, "yyyyMMdd")).alias("url"), kind.alias("kind"), at.alias("at"))


_STATUS = f"""with {_QUEUE} select url, case when done then 'done' when failures >= 3 then 'dead' when failures > 0 and last + 86400000 * (1 << greatest(failures - 1, 0)) > now then 'waiting' else 'pending' end as status, failures from p, w"""


@query(_STATUS)
def queue_of_urls(spark, sf_dir):
    """What became of each url, from a table of events."""
    rows = _url_events(E.table(spark, sf_dir, "events"))
    end = rows.agg((F.unix_millis(F.max("at")) - 600_000).alias("_now"))
    return Q.queue_status(rows.crossJoin(F.broadcast(end)), F.col("_now"), wait_ms=86_400_000, also=["_now"]).select("url", "status", "failures")


@query(_STATUS)
def streamed_queue_of_urls(spark, sf_dir):
    """The same from a stream of the events, with the urls' sums as its state; waits end by the stream's watermark."""
    schema, folder, pattern = _event_files(spark, sf_dir)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    return Q.run_queue(_url_events(stream), shared_folder(spark), shared_folder(spark), wait_ms=86_400_000, late="10 minutes")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all", dates="start")
def streamed_event_counts(spark, sf_dir):
    """The same counts by a stream with a watermark; the last count of each window is the largest."""
    schema, folder, pattern = _event_files(spark, sf_dir)

    def counts(stream):
        return I.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))

    out = I.streamed(spark, folder, pattern, schema, counts, shared_folder(spark), shared_folder(spark))
    return out.groupBy(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type").agg(F.max("n").alias("n"))


@query(
    """with g as (select user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by epoch(ts), event_id) as gap from events)
    select user_id, avg(gap) as mean_gap, stddev_pop(gap) as std_gap, count(*) as n, stddev_pop(gap) < 0.3 * avg(gap) as is_regular from g where gap is not null group by 1""",
    rounded="mean_gap std_gap",
    places=2,
)
def event_regularity(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return Z.regular(rows, ["user_id"], "at")


@query(
    """with f as (select user_id, event_id, value > 50 as big, lag(value > 50) over (partition by user_id order by event_id) as before from events),
    r as (select *, sum((before is null or before <> big)::int) over (partition by user_id order by event_id) as run from f)
    select user_id, any_value(big) as big, min(event_id) as first, max(event_id) as last, count(*) as n from r group by user_id, run"""
)
def event_islands(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", (F.col("value") > 50).alias("big"))
    return Z.islands(rows, ["user_id"], "event_id", "big")


@query("select p_partkey, p_partkey::varchar || ' ' || p_size::varchar as text from part")
def morse_text(spark, sf_dir):
    code = {v: k for k, v in Z.S.MORSE.items()}
    table = F.create_map(*(F.lit(x) for d in "0123456789" for x in (d, code[d])))

    def symbols(c):
        return F.array_join(F.transform(F.split(F.col(c).cast("string"), ""), lambda d: F.coalesce(F.try_element_at(table, d), F.lit(""))), " ")

    return E.table(spark, sf_dir, "part").select("p_partkey", Z.morse_decoded(F.concat_ws(" / ", symbols("p_partkey"), symbols("p_size"))).alias("text"))


def _clips(spark, sf_dir):
    """A clip of half a second for every supplier: a carrier that goes on and off, by the key, with a weak tone above."""
    carrier = 1000 + 50 * (F.col("clip") % 12)

    def sample(i):
        t = i / 8000.0
        on = F.when(F.floor(i / 400) % 3 == 0, 1.0).otherwise(0.1)
        return on * F.sin(2 * F.pi() * carrier * t) + 0.05 * F.sin(2 * F.pi() * 3500 * t)

    rows = E.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"))
    # The keys' file is small, but each is a clip of 32 kB, so keys are dealt to tasks before clips are made.
    rows = rows.repartition(max(1, -(-rows.count() // TASK_CLIPS)), "clip")
    return rows.select("clip", F.transform(F.sequence(F.lit(0), F.lit(3999)), sample).alias("samples"), F.lit(8000).alias("rate"))


@query()
def signal_bands(spark, sf_dir):
    return Z.band_energy(_clips(spark, sf_dir), ((0, 1000), (1000, 3000), (3000, 4000))).select("clip", F.round(F.element_at("ratios", 3), 4).alias("high"), "level")


@query()
def signal_fm(spark, sf_dir):
    return Z.fm_stats(_clips(spark, sf_dir), 800, 2000)


@query()
def signal_psk(spark, sf_dir):
    return Z.psk_rate(_clips(spark, sf_dir), 1000)


@query()
def signal_images(spark, sf_dir):
    return Z.band_images(_clips(spark, sf_dir), 500, 3000, 256, 128).select("clip", F.size("image").alias("rows"), "edge_mean", "bright")


@query()
def signal_morse(spark, sf_dir):
    return Z.morse(_clips(spark, sf_dir), ((800, 1800),))


@query()
def signal_coherence(spark, sf_dir):
    parts = Z.segments(_clips(spark, sf_dir), seconds=1, most=6).withColumn("key", F.concat_ws("-", "clip", "segment"))
    return Z.phase_coherence(parts, "key")


@query()
def signal_spikes(spark, sf_dir):
    return Z.spike_counts(_clips(spark, sf_dir))


@query()
def signal_bits(spark, sf_dir):
    return Z.bits_text(_clips(spark, sf_dir), 50)


@query()
def signal_periods(spark, sf_dir):
    return Z.envelope_periods(_clips(spark, sf_dir), 1500).select("clip", F.round(F.element_at("autocorrelation", 1201), 3).alias("at_period"))


@query(f"with {E.POINTS} select 'Feature' as type, 'Point' as shape, lon::double as lon, lat::double as lat, id, title from points")
def geojson_export(spark, sf_dir):
    """Features as they are exported, read back."""
    kind = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<id:long,title:string>"
    rows = sinks.geojson_features(E.points(spark, sf_dir), ("id", "title")).select(F.from_json("feature", kind).alias("f"))
    at = F.col("f.geometry.coordinates")
    return rows.select("f.type", F.col("f.geometry.type").alias("shape"), F.element_at(at, 1).alias("lon"), F.element_at(at, 2).alias("lat"), "f.properties.id", "f.properties.title")


@query(f"""with {E.ARTICLES}, {E.BIBLIOGRAPHY}, n as (select article_id, count(*) as entries, string_agg(position || ' ' || author || ': ' || title, '; ' order by position, author, title) as listed from bib group by 1)
    select article_id, url, coalesce(entries, 0) as entries, coalesce(listed, '') as listed from articles left join n using (article_id)""")
def nested_export(spark, sf_dir):
    """Documents of articles with their entries, as they are exported, read back."""
    entries = E.bibliography(spark, sf_dir).select("article_id", "position", "author", "title")
    rows = sinks.nested_articles(E.articles(spark, sf_dir).select("article_id", "url"), bibliography=entries)
    kind = "article_id long, url string, bibliography array<struct<position:int,author:string,title:string>>"
    listed = F.transform("d.bibliography", lambda e: F.concat(e["position"].cast("string"), F.lit(" "), e["author"], F.lit(": "), e["title"]))
    return rows.select(F.from_json("document", kind).alias("d")).select("d.article_id", "d.url", F.size("d.bibliography").cast("long").alias("entries"), F.array_join(listed, "; ").alias("listed"))


@query("with x as (select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey) select l_orderkey as article_id, l_linenumber::bigint as position, 'http://site/' || strftime(o.o_orderdate, '%Y/%m') || '/' || l_orderkey || '.html' as article_url from lineitem l join orders o on l_orderkey = o_orderkey")
def denormalised_export(spark, sf_dir):
    rows = E.bibliography(spark, sf_dir).select("article_id", F.col("position").cast("long").alias("position"))
    return sinks.with_article(rows, E.articles(spark, sf_dir)).select("article_id", "position", "article_url")


@query(
    f"""with {spatial._CODES} select (case when v1 < 0 then '-' else '+' end) || lpad(abs(v1)::varchar, 3, '0') || (case when v2 < 0 then '-' else '+' end) || lpad(abs(v2)::varchar, 3, '0') as code,
    case when method <> 'celestial' then lat end as lat, case when method <> 'celestial' then lon end as lon, method, case when method <> 'celestial' then {spatial._region('lat', 'lon')} end as region, 'part' as title, p_partkey::varchar as url
    from dec where method is not null""",
    rounded="lat lon",
    places=3,
)
def code_export(spark, sf_dir):
    rows = spatial._decoded(spark, sf_dir).filter("method is not null").withColumn("region", region(F.col("lat"), F.col("lon"))).withColumn("title", F.lit("part")).withColumn("url", F.col("p_partkey").cast("string"))
    return sinks.code_exports(rows)["combined"]
