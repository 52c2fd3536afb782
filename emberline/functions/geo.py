"""Geodesy as Column expressions: no Python runs for any of these.

Longitudes and latitudes are degrees of WGS84 (EPSG:4326), Mercator coordinates
are metres of EPSG:3857.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111320.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563

E2 = WGS84_F * (2 - WGS84_F)
E1 = math.sqrt(E2)


def _q(s: float) -> float:
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


#: Authalic q at the pole, and the square of the authalic radius in square metres.
Q_POLE = _q(1.0)
AUTHALIC_R2 = WGS84_A**2 * Q_POLE / 2


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * WGS84_A


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WGS84_A


def inverse_mercator_lon(x: Column) -> Column:
    return F.degrees(x / WGS84_A)


def inverse_mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the sphere of EARTH_RADIUS_KM."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def sin_authalic(lat: Column) -> Column:
    """Sine of the authalic latitude."""
    s = F.sin(F.radians(lat))
    return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) / Q_POLE


def box_area_m2(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Ellipsoidal area between two meridians and two parallels."""
    return AUTHALIC_R2 * F.radians(maxx - minx) * (sin_authalic(maxy) - sin_authalic(miny))


def mercator_area_scale(lat: Column) -> Column:
    """Mercator area over ellipsoidal area at a latitude."""
    phi = F.radians(lat)
    return F.pow(1 - E2 * F.pow(F.sin(phi), 2), 2) / (F.pow(F.cos(phi), 2) * (1 - E2))


def degree_pixel_area_m2(width: Column, height: Column, lat: Column) -> Column:
    """Area of a pixel whose sides are degrees, in the plane approximation at its latitude."""
    return width * METRES_PER_DEGREE * F.cos(F.radians(lat)) * (height * METRES_PER_DEGREE)


def square_buffer(lon: Column, lat: Column, side_m: float = 1000.0) -> dict[str, Column]:
    """Degrees bounds of the square of `side_m` Mercator metres around a point."""
    x, y, h = mercator_x(lon), mercator_y(lat), side_m / 2
    return {"minx": inverse_mercator_lon(x - h), "miny": inverse_mercator_lat(y - h), "maxx": inverse_mercator_lon(x + h), "maxy": inverse_mercator_lat(y + h)}


def degree_buffer(lon: Column, lat: Column, half: float = 0.5) -> dict[str, Column]:
    """Bounds of the square of degrees around a point."""
    return {"minx": lon - half, "miny": lat - half, "maxx": lon + half, "maxy": lat + half}


def mercator_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column, points: int = 21) -> dict[str, Column]:
    """Mercator bounds of a box of degrees, from `points` points of each side."""
    steps = [k / (points - 1) for k in range(points)]
    xs = [mercator_x(minx + (maxx - minx) * t) for t in steps]
    ys = [mercator_y(miny + (maxy - miny) * t) for t in steps]
    return {"minx": F.least(*xs), "miny": F.least(*ys), "maxx": F.greatest(*xs), "maxy": F.greatest(*ys)}


def in_disc(lon: Column, lat: Column, px: Column, py: Column, radius_m: float = 500.0) -> Column:
    """Whether a point lies in the Mercator disc around another."""
    return F.hypot(mercator_x(px) - mercator_x(lon), mercator_y(py) - mercator_y(lat)) <= radius_m


def _edges(ring: Column) -> Column:
    """Consecutive points of a closed ring (array of structs x, y) as pairs."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area_m2(ring: Column) -> Column:
    """Ellipsoidal area of a closed ring of degrees, whatever its orientation: great-circle edges on the authalic sphere."""

    def part(e: Column) -> Column:
        t1, t2 = F.tan(F.asin(sin_authalic(e["a"]["y"])) / 2), F.tan(F.asin(sin_authalic(e["b"]["y"])) / 2)
        return 2 * F.atan2(F.tan(F.radians(e["b"]["x"] - e["a"]["x"]) / 2) * (t1 + t2), 1 + t1 * t2)

    return F.when(F.size(ring) < 4, 0.0).otherwise(AUTHALIC_R2 * F.abs(_total(F.transform(_edges(ring), part))))


def ring_shoelace(ring: Column) -> Column:
    """Unsigned plane area of a closed ring."""
    return F.abs(_total(F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def ring_centroid(ring: Column) -> Column:
    """Area-weighted plane centroid of a closed ring as struct (x, y); null for a ring without area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    twice = _total(F.transform(_edges(ring), cross))
    x = _total(F.transform(_edges(ring), lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)))
    y = _total(F.transform(_edges(ring), lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)))
    return F.when(twice != 0, F.struct((x / (3 * twice)).alias("x"), (y / (3 * twice)).alias("y")))


def polygon_area_m2(parts: Column) -> Column:
    """Ellipsoidal area of a (multi)polygon: array of structs shell, holes. Null and no parts give 0."""
    one = lambda p: ring_area_m2(p["shell"]) - _total(F.transform(p["holes"], ring_area_m2))
    return F.coalesce(_total(F.transform(parts, one)), F.lit(0.0))
