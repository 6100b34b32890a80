"""Geographic expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = F.radians(_c(lat2) - _c(lat1)) / 2
    dl = F.radians(_c(lon2) - _c(lon1)) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def block_id(lon, lat, degrees) -> Column:
    d = degrees if isinstance(degrees, Column) else F.lit(float(degrees))
    return F.concat_ws(
        "_", F.floor(_c(lon) / d).cast("string"), F.floor(_c(lat) / d).cast("string")
    )


def cell_km(degrees, mean_lat) -> Column:
    """Rough side of a block in km at the mean latitude."""
    return _c(degrees) * (KM_PER_DEGREE + KM_PER_DEGREE * F.cos(F.radians(_c(mean_lat)))) / 2


def point_in_ring(x, y, ring) -> Column:
    """Even-odd rule over an array of (x, y) vertices; the ring may be open or closed."""
    x, y, ring = _c(x), _c(y), _c(ring)
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when(
            _edge_crossed(x, y, F.element_at(ring, i), F.element_at(ring, i % n + 1)), 1
        ).otherwise(0),
    )
    return crossings % 2 == 1


def _edge_crossed(x, y, a, b) -> Column:
    straddles = (a["y"] > y) != (b["y"] > y)
    at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
    return straddles & (x < at)
