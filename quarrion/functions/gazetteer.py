"""Default gazetteers; every operator takes another one as a table (name, lat, lon, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Known sites and magnetic anomalies with latitude and longitude.
FACILITIES = (
    ("Dugway Proving Ground", 40.17, -112.94),
    ("Pantex Plant", 35.32, -101.57),
    ("White Sands", 32.38, -106.48),
    ("Edwards AFB", 34.91, -117.88),
    ("China Lake NAWS", 35.69, -117.69),
    ("Yulin Naval Base", 18.22, 109.56),
    ("Ghazni", 33.55, 68.42),
    ("Dushanbe", 38.56, 68.77),
    ("Mecca", 21.43, 39.83),
)
ANOMALIES = (
    ("South Atlantic Anomaly", -30.0, -40.0),
    ("SAA African Lobe", -25.0, 18.0),
    ("Bangui Anomaly", 5.0, 18.0),
    ("Kursk Magnetic Anomaly", 51.7, 37.5),
    ("Bermuda Triangle", 25.0, -71.0),
)
# The other gazetteer, with what a facility is, and with radii of anomalies in km.
TYPED_FACILITIES = (
    ("Dugway Proving Ground", 40.18, -112.93, "Military"),
    ("Pantex Plant", 35.32, -101.57, "Nuclear"),
    ("AUTEC", 24.75, -77.75, "Naval"),
    ("White Sands", 32.38, -106.48, "Military"),
    ("China Lake", 35.69, -117.69, "Military"),
    ("Edwards AFB", 34.91, -117.88, "Military"),
    ("Thule Air Base", 76.53, -68.70, "Military"),
    ("Yulin Naval Base", 18.22, 109.56, "Naval"),
)
ANOMALY_ZONES = (
    ("South Atlantic Anomaly", -30.0, -40.0, 3000),
    ("SAA African Lobe", -25.0, 15.0, 1500),
    ("Kursk Magnetic Anomaly", 51.7, 36.2, 300),
    ("Bangui Anomaly", 6.0, 18.0, 1000),
    ("Bermuda Triangle", 25.0, -71.0, 800),
)


def sites(spark: SparkSession, kind: str = "facility") -> DataFrame:
    """name, lat, lon and ord, the place in the list that breaks ties."""
    rows = FACILITIES if kind == "facility" else ANOMALIES
    return spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "name string, lat double, lon double, ord int")


def typed_facilities(spark: SparkSession) -> DataFrame:
    """name, lat, lon, type and ord."""
    return spark.createDataFrame([(*x, i) for i, x in enumerate(TYPED_FACILITIES)], "name string, lat double, lon double, type string, ord int")


def anomaly_zones(spark: SparkSession) -> DataFrame:
    """name, lat, lon, radius (km) and ord."""
    return spark.createDataFrame([(*x, i) for i, x in enumerate(ANOMALY_ZONES)], "name string, lat double, lon double, radius int, ord int")
