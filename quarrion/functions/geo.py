"""Column functions on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371

# Ordered latitude and longitude boxes (least and most, inclusive; None is open); the first that fits.
REGIONS = (
    ("Arctic", (66, None), None),
    ("Antarctic", (None, -60), None),
    ("Central Asia", (30, 60), (20, 90)),
    ("North America", (15, 45), (-130, -65)),
    ("Africa/Middle East", (-10, 35), (-20, 55)),
    ("Southern Africa", (-40, -10), (10, 65)),
    ("East Asia", (20, 55), (90, 145)),
    ("South America", (-15, 15), (-80, -35)),
    ("Europe", (35, 70), (-10, 40)),
)
OTHER_REGION = "Ocean/Other"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def region(lat: Column, lon: Column) -> Column:
    """Name of the first box that holds the point; the polar caps are open boxes without their edge."""
    out = None
    for name, (low, high), span in REGIONS:
        if high is None:
            fits = lat > low
        elif low is None:
            fits = lat < high
        else:
            fits = lat.between(low, high) & lon.between(*span)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(OTHER_REGION)
