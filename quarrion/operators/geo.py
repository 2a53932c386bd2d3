"""Joins and aggregations of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions.geo import RADIUS_KM, haversine
from quarrion.storage import discard, written

#: Most sites that are sent to all tasks; more are joined by grid cells.
MOST_SITES = 10_000
KM_PER_DEGREE = 3.141592653589793 * RADIUS_KM / 180
#: The hierarchy of cells over sites: degrees of the first level, halvings and levels, and the sites that aren't parted further.
TOP_DEGREES, FAN_BITS, LEVELS, LEAF_SITES = 45.0, 3, 7, 32
#: More than the distances' rounding.
SLACK_KM = 1e-6


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step).cast("long")


def _cells(band: Column, step: float) -> Column:
    """How many cells go round the globe in a band of latitude."""
    middle = F.radians((band + 0.5) * step - 90)
    return F.greatest(F.lit(1), F.floor(360 * F.greatest(F.cos(middle), F.lit(0.0)) / step)).cast("long")


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * cells).cast("long"), cells)


def within_km(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of rows at most km apart, as columns l, r (structs of the sides' rows) and km, by an equi-join on grid cells.

    A left point is in one cell; a right point is in all cells that its reach touches, in its own band of latitude and
    the ones beside. Rows without coordinates have no pairs.
    """
    step = max(km / KM_PER_DEGREE, 0.01)
    own = left.select(F.struct("*").alias("l")).filter(f"l.{lat} is not null and l.{lon} is not null").withColumn("band", _band(F.col(f"l.{lat}"), step))
    own = own.withColumn("cell", _cell(F.col(f"l.{lon}"), _cells(F.col("band"), step)))
    other = right.select(F.struct("*").alias("r")).filter(f"r.{lat} is not null and r.{lon} is not null").withColumn("o", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    other = other.withColumn("band", _band(F.col(f"r.{lat}"), step) + F.col("o")).withColumn("n", _cells(F.col("band"), step))
    # The widest span of longitude at that distance, over the latitudes of both bands; at the poles, all of it.
    edge = F.least(F.lit(90.0), F.greatest(F.abs((F.col("band") + 1) * step - 90), F.abs(F.col("band") * step - 90), F.abs(F.col(f"r.{lat}"))))
    ratio = F.sin(F.lit(km / RADIUS_KM / 2)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    reach = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    first = F.floor((F.col(f"r.{lon}") - reach + 180) / 360 * F.col("n")).cast("long")
    last = F.floor((F.col(f"r.{lon}") + reach + 180) / 360 * F.col("n")).cast("long")
    other = other.withColumn("cell", F.explode(F.sequence(first, F.least(last, first + F.col("n") - 1)))).withColumn("cell", F.pmod("cell", "n"))
    far = haversine(F.col(f"l.{lat}"), F.col(f"l.{lon}"), F.col(f"r.{lat}"), F.col(f"r.{lon}"))
    return own.join(other.drop("o", "n"), ["band", "cell"]).select("l", "r", far.alias("km")).filter(F.col("km") <= km)


def close_pairs(points: DataFrame, km: float = 50, key: str = "id") -> DataFrame:
    """Each two points less than km apart, the lesser key first."""
    both = within_km(points, points, km).filter((F.col(f"l.{key}") < F.col(f"r.{key}")) & (F.col("km") < km))
    return both.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), "km")


def _key(level: int, lat: Column, lon: Column) -> Column:
    """The cell of a coordinate: rows and columns of degrees, halved FAN_BITS times a level."""
    step = TOP_DEGREES / (1 << FAN_BITS * level)
    row = F.least(F.floor((lat + 90) / step), F.lit(round(180 / step) - 1))
    return F.shiftleft(row.cast("long"), 32) + F.floor(F.pmod(lon + 180, F.lit(360.0)) / step).cast("long")


def _middle(level: int, key: Column) -> tuple[Column, Column]:
    step = TOP_DEGREES / (1 << FAN_BITS * level)
    return (F.shiftright(key, 32) + 0.5) * step - 90, (key.bitwiseAND((1 << 32) - 1) + 0.5) * step - 180


def _parent(key: Column) -> Column:
    return F.shiftleft(F.shiftright(key, 32 + FAN_BITS), 32) + F.shiftright(key.bitwiseAND((1 << 32) - 1), FAN_BITS)


def site_cells(sites: DataFrame, levels: int = LEVELS, leaf: int = LEAF_SITES) -> tuple[DataFrame, DataFrame]:
    """The hierarchy over distinct sites: (level, key, parent, n, lat, lon, reach, leaf), and the sites with their leaf.

    reach is the greatest distance of a cell's sites from its middle. A cell with at most `leaf` sites, or of the last level, is
    a leaf; there are no cells below one.
    """
    own = written(sites.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min(F.struct("ord", "name")).alias("site")))
    at = F.array(*(F.struct(F.lit(k).alias("level"), _key(k, F.col("lat"), F.col("lon")).alias("key")) for k in range(levels)))
    rows = own.select("lat", "lon", F.explode(at).alias("at")).select("lat", "lon", "at.*")
    lat, lon = (F.element_at(F.array(*(_middle(k, F.col("key"))[i] for k in range(levels))), F.col("level") + 1) for i in (0, 1))
    rows = rows.select("level", "key", lat.alias("c_lat"), lon.alias("c_lon"), haversine(lat, lon, F.col("lat"), F.col("lon")).alias("km"))
    cells = rows.groupBy("level", "key").agg(F.count("*").alias("n"), F.first("c_lat").alias("c_lat"), F.first("c_lon").alias("c_lon"), F.max("km").alias("reach"))
    cells = written(cells.withColumn("leaf", (F.col("n") <= leaf) | (F.col("level") == levels - 1)))
    inner = cells.filter("not leaf").select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
    below = cells.withColumn("parent", _parent(F.col("key"))).join(inner, ["level", "parent"], "left_semi")
    tree = written(cells.filter("level = 0").withColumn("parent", F.lit(-1).cast("long")).unionByName(below))
    leaves = tree.filter("leaf").select("level", "key")
    placed = own.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "site", F.explode(at).alias("at")).select("s_lat", "s_lon", "site", "at.*")
    return tree, placed.join(leaves, ["level", "key"])


def _pruned(rows: DataFrame) -> DataFrame:
    """Cells of each point that may hold its nearest site: none is nearer to it than another's sites are for certain."""
    best = rows.groupBy(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(F.min("most").alias("_most"))
    both = rows.join(best, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")))
    return both.filter(F.col("least") <= F.col("_most") + SLACK_KM).select(*rows.columns)


def _bounded(rows: DataFrame) -> DataFrame:
    """Least and greatest distance of a point from a cell's sites, by the triangle inequality."""
    km = haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return rows.select("lat", "lon", "level", "key", "leaf", (km - F.col("reach")).alias("least"), (km + F.col("reach")).alias("most"))


def _nearest_by_cells(places: DataFrame, sites: DataFrame) -> DataFrame:
    """(_lat, _lon, _near) for distinct places, by descending the hierarchy of cells level by level."""
    tree, placed = site_cells(sites, LEVELS, LEAF_SITES)
    top = tree.filter("level = 0").drop("level", "parent", "n").agg(F.collect_list(F.struct("key", "leaf", "c_lat", "c_lon", "reach")).alias("_top"))
    first = places.crossJoin(F.broadcast(top)).select("lat", "lon", F.explode("_top").alias("c")).select("lat", "lon", F.lit(0).alias("level"), "c.*")
    rows = written(_pruned(_bounded(first)))
    for level in range(1, LEVELS):
        if not rows.filter("not leaf").limit(1).count():
            break
        own = tree.filter(F.col("level") == level).select("level", "key", "parent", "leaf", "c_lat", "c_lon", "reach")
        children = rows.filter("not leaf").select("lat", "lon", F.col("key").alias("parent")).join(own, "parent")
        after = written(_pruned(_bounded(children).unionByName(rows.filter("leaf"))))
        discard(rows)
        rows = after
    pairs = rows.select("lat", "lon", "level", "key").join(placed, ["level", "key"])
    km = haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    nearest = F.min(F.struct(km.alias("km"), F.col("site.ord").alias("ord"), F.col("site.name").alias("name")))
    return pairs.groupBy(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(nearest.alias("_near"))


def nearest_site(points: DataFrame, sites: DataFrame, prefix: str = "site") -> DataFrame:
    """points with the nearest site's name and distance, however far it is; of equally near ones the first by ord, then by name.

    Up to MOST_SITES sites go to all tasks as one array. More are found through a hierarchy of cells: a point keeps, level by
    level, the cells that may hold its nearest site by the bounds of their distances, and meets single sites only in the leaves
    that are left. Points without coordinates have no site.
    """
    if sites.limit(MOST_SITES + 1).count() <= MOST_SITES:
        listed = sites.agg(F.collect_list(F.struct("lat", "lon", "ord", "name")).alias("_sites"))
        far = F.transform("_sites", lambda s: F.struct(haversine(F.col("lat"), F.col("lon"), s["lat"], s["lon"]).alias("km"), s["ord"].alias("ord"), s["name"].alias("name")))
        near = points.crossJoin(F.broadcast(listed)).withColumn("_near", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array_min(far))).drop("_sites")
        return near.select(*points.columns, F.col("_near.name").alias(f"nearest_{prefix}"), F.col("_near.km").alias(f"{prefix}_km"))
    places = points.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter("lat is not null and lon is not null").distinct()
    found = _nearest_by_cells(places, sites)
    rows = points.join(found, (points.lat == F.col("_lat")) & (points.lon == F.col("_lon")), "left")
    return rows.select(*points.columns, F.col("_near.name").alias(f"nearest_{prefix}"), F.col("_near.km").alias(f"{prefix}_km"))


def zones_of(points: DataFrame, zones: DataFrame, key: str = "id") -> DataFrame:
    """(key, zones): the names, by ord, of the zones (name, lat, lon, radius in km, ord) in which each point lies, for points in any.

    Zones are few and have radii of their own; they are compared with the points as one small table.
    """
    if zones.limit(MOST_SITES + 1).count() > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} zones: join them by within_km with the largest radius")
    listed = zones.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "lat", "lon", "radius"))).alias("_zones"))
    own = F.filter("_zones", lambda z: haversine(F.col("lat"), F.col("lon"), z["lat"], z["lon"]) <= z["radius"])
    rows = points.crossJoin(F.broadcast(listed)).select(key, F.transform(own, lambda z: z["name"]).alias("zones"))
    return rows.filter(F.size("zones") > 0)


def near_point(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within km of a point; a band of latitude comes first, so that statistics can prune."""
    reach = km / KM_PER_DEGREE
    rows = points.filter(F.col("lat").between(lat - reach, lat + reach)).withColumn("km", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    return rows.filter(F.col("km") <= km)


def centroids(points: DataFrame, months: int = 12) -> DataFrame:
    """Mean coordinates and count per period of so many months from the first month on."""
    first = points.agg(F.trunc(F.min("month"), "MM").alias("first"))
    step = F.floor(F.months_between(F.trunc("month", "MM"), F.col("first")) / months).cast("int")
    per = points.filter("month is not null").crossJoin(F.broadcast(first)).groupBy(F.add_months("first", step * months).alias("period"))
    return per.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def temporal_clusters(points: DataFrame, months: int = 3, factor: float = 2.0, least: float = 3.0) -> DataFrame:
    """Months whose trailing sum reaches max(factor * mean * months, least), with the centroid of the points in the window.

    Sums of coordinates are kept per month, so the window runs over months, not points.
    """
    per = points.filter("month is not null").groupBy(F.trunc("month", "MM").alias("period")).agg(F.count("*").alias("n"), F.sum("lat").alias("s_lat"), F.sum("lon").alias("s_lon"))
    ends = per.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).filter("lo is not null")
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("period"))
    whole = spine.join(per, "period", "left").na.fill(0, ["n", "s_lat", "s_lon"])
    frame = Window.orderBy("period").rowsBetween(1 - months, 0)
    mean = F.avg("n").over(Window.partitionBy(F.lit(1)))
    sums = whole.select("period", F.sum("n").over(frame).alias("in_window"), F.sum("s_lat").over(frame).alias("lat"), F.sum("s_lon").over(frame).alias("lon"), mean.alias("mean"))
    hot = sums.filter((F.col("in_window") >= F.greatest(factor * F.col("mean") * months, F.lit(least))) & (F.col("in_window") > 0))
    return hot.select("period", "in_window", (F.col("lat") / F.col("in_window")).alias("lat"), (F.col("lon") / F.col("in_window")).alias("lon"))


def validated(new: DataFrame, known: DataFrame, facilities: DataFrame, celestial: str | None = None) -> DataFrame:
    """Tier of each new coordinate by its nearest known one: under 50 km, under 200 km, else near a facility (100 km), else none.

    celestial names a boolean column of coordinates in the sky, which aren't compared.
    """
    own = known.select(F.concat_ws(",", "lat", "lon").alias("name"), "lat", "lon", F.lit(0).alias("ord"))
    sky = F.coalesce(F.col(celestial), F.lit(False)) if celestial else F.lit(False)
    rows = nearest_site(nearest_site(new.filter(~sky), own, "known"), facilities, "facility")
    tier = F.when(F.col("known_km") < 50, "STRONG").when(F.col("known_km") < 200, "MODERATE").when(F.col("facility_km") < 100, "NEAR_FACILITY").otherwise("UNVALIDATED")
    rows = rows.withColumn("tier", tier)
    return rows.unionByName(new.filter(sky).withColumn("tier", F.lit("CELESTIAL")), allowMissingColumns=True) if celestial else rows
