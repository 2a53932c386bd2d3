"""Geographic and code-decoding queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrion.functions import decode as D
from quarrion.functions import gazetteer
from quarrion.functions.geo import REGIONS, haversine, region
from quarrion.operators import geo as G
from quarrion.operators.significance import two_samples
from quarrion.plans import entities as E
from quarrion.plans.registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2"
    return f"(2 * 6371 * asin(sqrt(least(1.0, {a}))))"


def _sites(name: str, rows) -> str:
    return f"{name}(name, lat, lon, ord) as (values " + ", ".join(f"('{n}', {a}::double, {b}::double, {i})" for i, (n, a, b) in enumerate(rows)) + ")"


FACILITY, ANOMALY = _sites("fac", gazetteer.FACILITIES), _sites("ano", gazetteer.ANOMALIES)
NAVAL = (
    "fac(name, lat, lon, type, ord) as (values " + ", ".join(f"('{n}', {a}::double, {b}::double, '{k}', {i})" for i, (n, a, b, k) in enumerate(gazetteer.TYPED_FACILITIES)) + "), "
    "ano(name, lat, lon, radius, ord) as (values " + ", ".join(f"('{n}', {a}::double, {b}::double, {r}, {i})" for i, (n, a, b, r) in enumerate(gazetteer.ANOMALY_ZONES)) + ")"
)


def _region(lat: str, lon: str) -> str:
    out = []
    for name, (low, high), span in REGIONS:
        fits = f"{lat} > {low}" if high is None else f"{lat} < {high}" if low is None else f"{lat} between {low} and {high} and {lon} between {span[0]} and {span[1]}"
        out.append(f"when {fits} then '{name}'")
    return f"case {' '.join(out)} else 'Ocean/Other' end"


NEAREST = f"""{E.POINTS}, {FACILITY}, {ANOMALY},
nf as (select p.*, arg_min(f.name, {{k}} * 1000 + f.ord * 0.0000001) as nearest_facility, min({{k}}) as facility_km from points p, fac f group by all),
near as (select p.*, arg_min(f.name, {{k}} * 1000 + f.ord * 0.0000001) as nearest_anomaly, min({{k}}) as anomaly_km from nf p, ano f group by all)""".format(k=_km("p.lat", "p.lon", "f.lat", "f.lon"))


def _near(spark, sf_dir):
    rows = G.nearest_site(E.points(spark, sf_dir), gazetteer.sites(spark), "facility")
    return G.nearest_site(rows, gazetteer.sites(spark, "anomaly"), "anomaly")


@query(f"with {E.POINTS} select id, {_km('lat', 'lon', '40.17', '-112.94')} as km from points", rounded="km", places=3)
def haversine_distance(spark, sf_dir):
    return E.points(spark, sf_dir).select("id", haversine(F.col("lat"), F.col("lon"), F.lit(40.17), F.lit(-112.94)).alias("km"))


@query(f"with {E.POINTS} select id, {_region('lat', 'lon')} as region from points")
def region_classes(spark, sf_dir):
    return E.points(spark, sf_dir).select("id", region(F.col("lat"), F.col("lon")).alias("region"))


@query(f"with {NEAREST} select id, nearest_facility, facility_km, nearest_anomaly, anomaly_km from near", rounded="facility_km anomaly_km", places=1)
def nearest_sites(spark, sf_dir):
    return _near(spark, sf_dir).select("id", "nearest_facility", "facility_km", "nearest_anomaly", "anomaly_km")


@query(f"with {NEAREST} select nearest_facility, count(*) as n from near group by 1")
def points_by_facility(spark, sf_dir):
    return _near(spark, sf_dir).groupBy("nearest_facility").agg(F.count("*").alias("n"))


@query(
    f"""with {NEAREST} select count(*) as n, avg(facility_km) as avg_facility_km, avg(anomaly_km) as avg_anomaly_km, count(*) filter (where anomaly_km < 1000) as near_anomaly,
    100.0 * count(*) filter (where anomaly_km < 1000) / nullif(count(*), 0) as pct_near_anomaly from near""",
    rounded="avg_facility_km avg_anomaly_km pct_near_anomaly",
    places=2,
)
def coordinate_stats(spark, sf_dir):
    close = F.col("anomaly_km") < 1000
    return _near(spark, sf_dir).agg(
        F.count("*").alias("n"), F.avg("facility_km").alias("avg_facility_km"), F.avg("anomaly_km").alias("avg_anomaly_km"), F.count_if(close).alias("near_anomaly"), F.try_divide(100.0 * F.count_if(close), F.count("*")).alias("pct_near_anomaly")
    )


@query(f"with {E.POINTS} select id, {_km('lat', 'lon', '30.0', '60.0')} as km from points where {_km('lat', 'lon', '30.0', '60.0')} <= 1500", rounded="km", places=3)
def radius_search(spark, sf_dir):
    return G.near_point(E.points(spark, sf_dir), 30.0, 60.0, 1500).select("id", "km")


@query(f"with {NEAREST} select id from near where lower(nearest_facility) like '%naval%' and {_km('lat', 'lon', '18.0', '100.0')} <= 3000")
def radius_and_facility_search(spark, sf_dir):
    near = G.near_point(_near(spark, sf_dir), 18.0, 100.0, 3000)
    return near.filter(F.lower("nearest_facility").contains("naval")).select("id")


@query(f"with {E.POINTS} select a.id as a, b.id as b, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from points a join points b on a.id < b.id where {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 50", rounded="km", places=3)
def close_pairs(spark, sf_dir):
    return G.close_pairs(E.points(spark, sf_dir))


_DATED = f"""{E.POINTS}, dated as (select *, cast(date '1995-01-01' + to_months((id % 80)::int) as date) as month from points)"""


def _dated(spark, sf_dir):
    return E.points(spark, sf_dir).withColumn("month", F.add_months(F.to_date(F.lit("1995-01-01")), (F.col("id") % 80).cast("int")))


@query(
    f"""with {_DATED}, f as (select min(month) as first from dated)
    select cast(first + to_months((datediff('month', first, month) // 12 * 12)::int) as date) as period, avg(lat) as lat, avg(lon) as lon, count(*) as n from dated, f group by 1""",
    dates="period",
    rounded="lat lon",
)
def centroid_by_period(spark, sf_dir):
    return G.centroids(_dated(spark, sf_dir))


@query(
    f"""with {_DATED}, squared as (select *, cast(date '1995-01-01' + to_months((id * id % 80)::int) as date) as month from points), m as (select month as period, count(*) as n, sum(lat) as a, sum(lon) as b from squared group by 1),
    s as (select cast(unnest(generate_series((select min(period) from m), (select max(period) from m), interval 1 month)) as date) as period),
    w as (select s.period, coalesce(n, 0) as n, coalesce(a, 0) as a, coalesce(b, 0) as b from s left join m using (period)),
    r as (select period, sum(n) over f as c, sum(a) over f as a, sum(b) over f as b, avg(n) over () as mean from w window f as (order by period rows between 2 preceding and current row))
    select period, c::bigint as in_window, a / c as lat, b / c as lon from r where c >= greatest(1.1 * mean * 3, 3)""",
    dates="period",
    rounded="lat lon",
    places=3,
)
def temporal_clusters(spark, sf_dir):
    rows = E.points(spark, sf_dir).withColumn("month", F.add_months(F.to_date(F.lit("1995-01-01")), (F.col("id") * F.col("id") % 80).cast("int")))
    return G.temporal_clusters(rows, factor=1.1)


@query(
    f"""with {E.POINTS}, {FACILITY}, new as (select * from points where type = 'BUILDING'), known as (select * from points where type <> 'BUILDING'),
    k as (select n.id, n.lat, n.lon, min({_km("n.lat", "n.lon", "k.lat", "k.lon")}) as known_km from new n, known k group by all),
    f as (select k.*, min({_km("k.lat", "k.lon", "f.lat", "f.lon")}) as facility_km from k, fac f group by all)
    select id, case when known_km < 50 then 'STRONG' when known_km < 200 then 'MODERATE' when facility_km < 100 then 'NEAR_FACILITY' else 'UNVALIDATED' end as tier from f"""
)
def coordinate_validation(spark, sf_dir):
    rows = E.points(spark, sf_dir)
    return G.validated(rows.filter("type = 'BUILDING'"), rows.filter("type != 'BUILDING'"), gazetteer.sites(spark)).select("id", "tier")


def _codes(spark, sf_dir):
    one, two = ((F.col("p_partkey") * m) % 1999 - 999 for m in (37, 61))
    text = F.concat(*(F.concat(F.when(v < 0, "-").otherwise("+"), F.lpad(F.abs(v).cast("string"), 3, "0")) for v in (one, two)))
    tag = F.when(F.col("p_partkey") % 3 == 0, "MilDSP relay").otherwise("orbital note")
    return E.table(spark, sf_dir, "part").select("p_partkey", text.alias("code"), tag.alias("context"))


_CODES = """codes as (select p_partkey, (p_partkey * 37) % 1999 - 999 as v1, (p_partkey * 61) % 1999 - 999 as v2, p_partkey % 3 = 0 as tagged from part),
d as (select *, 21 + v1 as slat, v2 / 4.0 as slon, v2 / 10.0 as llat, v1 / 10.0 as llon, -0.0197 * v1 + 37.61 as dlat, 1.1247 * v2 - 93.96 as dlon,
    case when abs(v1) < 100 then 0 else abs(v1) // 100 end as hh, case when abs(v1) < 100 then abs(v1) else abs(v1) % 100 end as mm from codes),
m as (select *, case when not tagged and abs(v1) <= 90 and slat between -90 and 90 and slon between -180 and 180 then 'small'
    when not tagged and abs(v1) > 90 and llat between -90 and 90 and llon between -180 and 180 then 'large'
    when dlat between -90 and 90 and dlon between -180 and 180 then 'dsp'
    when hh <= 24 and mm <= 59 and abs(v2 / 10.0) <= 90 then 'celestial' end as method from d),
dec as (select *, case method when 'small' then slat when 'large' then llat when 'dsp' then dlat when 'celestial' then v2 / 10.0 end::double as lat,
    case method when 'small' then slon when 'large' then llon when 'dsp' then dlon when 'celestial' then hh + mm / 60.0 end::double as lon from m)"""


def _decoded(spark, sf_dir):
    rows = _codes(spark, sf_dir)
    v1, v2 = D.parse_code(F.col("code"))
    rows = rows.withColumn("v1", v1).withColumn("v2", v2)
    # Exploded, so that the long expression is computed once and not copied to each place that uses its parts.
    place = F.explode(F.array(D.decode(F.col("v1"), F.col("v2"), F.col("context"))))
    return rows.withColumn("p", place).select("p_partkey", "code", "v1", "v2", "p.*")


@query(f"with {_CODES} select p_partkey, v1, v2, method, lat, lon, coalesce(method = 'celestial', false) as is_celestial from dec", rounded="lat lon")
def decoded_codes(spark, sf_dir):
    rows = _decoded(spark, sf_dir)
    return rows.select("p_partkey", "v1", "v2", "method", "lat", "lon", F.coalesce("is_celestial", F.lit(False)).alias("is_celestial"))


@query(f"with {_CODES} select {_region('lat', 'lon')} as region, count(*) as n, count(distinct v1 * 10000 + v2) as n_codes from dec where method in ('small', 'large', 'dsp') group by 1")
def decoded_regions(spark, sf_dir):
    rows = _decoded(spark, sf_dir).filter("not is_celestial")
    return rows.groupBy(region(F.col("lat"), F.col("lon")).alias("region")).agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"))


@query(f"with {_CODES}, {FACILITY} select p_partkey, arg_min(f.name, {_km('d.lat', 'd.lon', 'f.lat', 'f.lon')}) as nearest_facility, min({_km('d.lat', 'd.lon', 'f.lat', 'f.lon')}) as facility_km from dec d, fac f where method in ('small', 'large', 'dsp') group by p_partkey having facility_km < 200", rounded="facility_km", places=1)
def codes_near_facilities(spark, sf_dir):
    rows = _decoded(spark, sf_dir).filter("not is_celestial")
    return G.nearest_site(rows, gazetteer.sites(spark), "facility").filter("facility_km < 200").select("p_partkey", "nearest_facility", "facility_km")


@query(f"with {_CODES} select p_partkey, v1 * 10000 + v2 in (select v1 * 10000 + v2 from codes join part using (p_partkey) where p_size <= 25) as known from dec where method is not null")
def known_and_new_codes(spark, sf_dir):
    rows = _decoded(spark, sf_dir).filter("method is not null")
    small = E.table(spark, sf_dir, "part").filter("p_size <= 25").select("p_partkey")
    known = _codes(spark, sf_dir).join(small, "p_partkey").select("code").distinct()
    return rows.join(known, "code", "left_semi").select("p_partkey", F.lit(True).alias("known")).unionByName(rows.join(known, "code", "left_anti").select("p_partkey", F.lit(False).alias("known")))


@query(
    f"""with {_CODES}, {E.POINTS}, {FACILITY}, e as (select p_partkey, lat, lon from dec where method in ('small', 'large', 'dsp')),
    k as (select e.*, min({_km("e.lat", "e.lon", "p.lat", "p.lon")}) as known_km from e, points p group by all),
    f as (select k.*, min({_km("k.lat", "k.lon", "f.lat", "f.lon")}) as facility_km from k, fac f group by all)
    select p_partkey, case when known_km < 50 then 'STRONG' when known_km < 200 then 'MODERATE' when facility_km < 100 then 'NEAR_FACILITY' else 'UNVALIDATED' end as tier from f
    union all select p_partkey, 'CELESTIAL' from dec where method = 'celestial'"""
)
def code_validation(spark, sf_dir):
    """Decoded codes against the known points; those in the sky aren't compared."""
    rows = _decoded(spark, sf_dir).filter("method is not null")
    return G.validated(rows, E.points(spark, sf_dir), gazetteer.sites(spark), celestial="is_celestial").select("p_partkey", "tier")


_CONTEXT = f"substr(text, greatest(1, pos - {D.CONTEXT}), length(code) + {D.CONTEXT} + least(pos - 1, {D.CONTEXT}))"


@query(
    f"""with {_CODES}, t as (
        select *, 'http://site/' || (p_partkey % 50) as url, (case when v1 < 0 then '-' else '+' end) || lpad(abs(v1)::varchar, 3, '0') || (case when v2 < 0 then '-' else '+' end) || lpad(abs(v2)::varchar, 3, '0') as main,
               'report ' || case when tagged then 'MilDSP relay' else 'orbital note' end || ': ' as head from codes),
    x as (select *, head || main || ' end; page -05-25 of DASYS2075-05-25' as text from t),
    found as (
        select url, main as code, text, length(head) + 1 as pos from x where tagged or not ((v1 < 0 and v2 < 0 and v1 >= -31 and v2 >= -31) or (v1 < 0 and v1 > -20 and abs(v2) < 20))
        union all select url, '-05-25', text, length(head || main || ' end; page ') + 1 from x where tagged)
    select code, url, min({_CONTEXT}) as context from found group by all"""
)
def codes_in_text(spark, sf_dir):
    """Codes with context found in texts made of names and codes, one row per (code, url)."""
    rows = _codes(spark, sf_dir).select(F.concat(F.lit("report "), F.col("context"), F.lit(": "), F.col("code"), F.lit(" end; page -05-25 of DASYS2075-05-25")).alias("text"), F.concat(F.lit("http://site/"), F.col("p_partkey") % 50).alias("url"))
    found = rows.select("url", F.explode(D.codes_in(F.col("text"))).alias("c")).select("url", "c.code", "c.context")
    return found.groupBy("code", "url").agg(F.min("context").alias("context"))


def _even(salt: str) -> Column:
    """A number from 0 to 1 that depends on the id alone, not on the partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


_EVEN_SQL = "(('0x' || substr(md5('{}' || id::varchar), 1, 8))::bigint)::double / 4294967296"


@query(
    f"""with {E.POINTS}, {FACILITY},
    even as (select id, degrees(asin(2 * {_EVEN_SQL.format("lat")} - 1)) as lat, 360 * {_EVEN_SQL.format("lon")} - 180 as lon from points),
    rows as (
        select 1 as own, p.id, min({_km("p.lat", "p.lon", "f.lat", "f.lon")}) as x from points p, fac f group by all
        union all select 0, p.id, min({_km("p.lat", "p.lon", "f.lat", "f.lon")}) from even p, fac f group by all),
    m as (
        select avg(x) filter (where own = 1) as mean_a, avg(x) filter (where own = 0) as mean_b, var_samp(x) filter (where own = 1) / sum(own) as v_a,
               var_samp(x) filter (where own = 0) / sum(1 - own) as v_b, sum(own)::double as n_a, sum(1 - own)::double as n_b from rows),
    c as (select max(abs(a / n_a - b / n_b)) as ks from (select x, sum(own) over (order by x) as a, sum(1 - own) over (order by x) as b from rows), m),
    l as (select *, sqrt(n_a * n_b / (n_a + n_b)) * ks as size from m, c)
    select mean_a, mean_b, mean_a / mean_b as ratio, (mean_a - mean_b) / sqrt(v_a + v_b) as t, (v_a + v_b) ** 2 / (v_a ** 2 / (n_a - 1) + v_b ** 2 / (n_b - 1)) as df, ks,
           least(1.0, greatest(0.0, (select sum(2 * (case when j % 2 = 1 then 1 else -1 end) * exp(-2 * j * j * size * size)) from range(1, 101) r(j)))) as ks_p from l""",
    rounded="mean_a mean_b ratio t df ks ks_p",
)
def baseline_significance(spark, sf_dir):
    """Distances to the nearest site of the points against as many points spread evenly over the sphere: means, Welch's t, and Kolmogorov-Smirnov."""
    own = E.points(spark, sf_dir).select("id", "lat", "lon")
    even = own.select("id", F.degrees(F.asin(2 * _even("lat") - 1)).alias("lat"), (360 * _even("lon") - 180).alias("lon"))
    both = [G.nearest_site(x, gazetteer.sites(spark), "site").select(F.col("site_km").alias("x"), F.lit(k).alias("own")) for k, x in ((1, own), (0, even))]
    return two_samples(both[0].unionByName(both[1]), "x", "own")


@query(
    f"""with {E.POINTS}, {NAVAL}, near as (select p.id, p.lat, p.lon, arg_min(f.name, {_km("p.lat", "p.lon", "f.lat", "f.lon")} * 1000 + f.ord * 0.0000001) as nearest_facility, min({_km("p.lat", "p.lon", "f.lat", "f.lon")}) as facility_km from points p, fac f group by all),
    z as (select p.id, string_agg(a.name, ',' order by a.ord) as zones from points p, ano a where {_km("p.lat", "p.lon", "a.lat", "a.lon")} <= a.radius group by 1)
    select near.id, nearest_facility, fac.type as facility_type, facility_km, zones from near join fac on fac.name = nearest_facility left join z using (id)""",
    rounded="facility_km",
    places=1,
)
def sites_of_the_other_gazetteer(spark, sf_dir):
    """Nearest of the typed facilities, and the anomalies in whose radius a point lies."""
    points = E.points(spark, sf_dir).select("id", "lat", "lon")
    near = G.nearest_site(points, gazetteer.typed_facilities(spark), "facility")
    kinds = gazetteer.typed_facilities(spark).select(F.col("name").alias("nearest_facility"), F.col("type").alias("facility_type"))
    zones = G.zones_of(points, gazetteer.anomaly_zones(spark), "id").withColumn("zones", F.array_join("zones", ","))
    return near.join(F.broadcast(kinds), "nearest_facility").join(zones, "id", "left").select("id", "nearest_facility", "facility_type", "facility_km", "zones")
