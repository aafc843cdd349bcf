"""Distances, projections and boxes as Column expressions.  Coordinates are degrees, lengths metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii and degree lengths that results depend on.
EARTH_M = 6_371_008.8
EARTH_PLANNER_M = 6_371_000.0
EARTH_WEB_M = 6_378_137.0
DEGREE_PLANNER_M = 111_320.0


def lit(x: float) -> Column:
    return F.lit(float(x))


def round_up(x: Column, digits: int) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x * lit(10**digits) + lit(0.5)) / lit(10**digits)


def _half_chord(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dlat, dlng = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlng * dlng


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    # rounding may bring antipodes over 1, where the arcsine isn't a number; the chord is named once, as filters compute each mention anew
    return lit(2 * EARTH_M) * F.nanvl(F.asin(F.sqrt(_half_chord(lng1, lat1, lng2, lat2))), lit(math.pi / 2))


def haversine_planner(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """The planner's variant: another radius, and the arctangent form."""
    h = _half_chord(lng1, lat1, lng2, lat2)
    return lit(2 * EARTH_PLANNER_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def degree_lat_m(lat: Column) -> Column:
    p = F.radians(lat)
    return lit(111_132.92) - lit(559.82) * F.cos(2 * p) + lit(1.175) * F.cos(4 * p)


def degree_lng_m(lat: Column) -> Column:
    p = F.radians(lat)
    return lit(111_412.84) * F.cos(p) - lit(93.5) * F.cos(3 * p) + lit(0.118) * F.cos(5 * p)


def planar(lng: Column, lat: Column, ref_lng: float, ref_lat: float) -> tuple[Column, Column]:
    """East and north of one reference point for the whole query."""
    p = math.radians(ref_lat)
    east = 111_412.84 * math.cos(p) - 93.5 * math.cos(3 * p) + 0.118 * math.cos(5 * p)
    north = 111_132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p)
    return (lng - lit(ref_lng)) * lit(east), (lat - lit(ref_lat)) * lit(north)


def planar_distance(lng1: Column, lat1: Column, lng2: Column, lat2: Column, ref_lng: float, ref_lat: float) -> Column:
    (x1, y1), (x2, y2) = planar(lng1, lat1, ref_lng, ref_lat), planar(lng2, lat2, ref_lng, ref_lat)
    return F.hypot(x2 - x1, y2 - y1)


def equirectangular(lng: Column, lat: Column, ref_lng: float, ref_lat: float) -> tuple[Column, Column]:
    return (lng - lit(ref_lng)) * lit(DEGREE_PLANNER_M * math.cos(math.radians(ref_lat))), (lat - lit(ref_lat)) * lit(DEGREE_PLANNER_M)


def moved_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    x = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * lit(EARTH_PLANNER_M)


def relocated(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    return F.coalesce(moved_m(lng1, lat1, lng2, lat2) > lit(1), F.lit(False))


def viewport(lng: Column, lat: Column, radius_m: Column) -> Column:
    """(west, south, east, north) of a box with a margin of a fifth around a circle."""
    r = radius_m * lit(1.2)
    dlat = F.degrees(r / lit(EARTH_WEB_M))
    dlng = F.degrees(r / (lit(EARTH_WEB_M) * F.cos(F.radians(lat))))
    return F.struct((lng - dlng).alias("west"), (lat - dlat).alias("south"), (lng + dlng).alias("east"), (lat + dlat).alias("north"))


def growth_margin(budget_m: Column) -> Column:
    """Half the budget in whole metres; 0 where there is none."""
    bad = budget_m.isNull() | F.isnan(budget_m) | (F.abs(budget_m) == float("inf")) | (budget_m <= 0)
    return F.when(bad, lit(0)).otherwise(F.floor(budget_m / 2).cast("double"))


def pool_radius(radius_m: Column, budget_m: Column) -> Column:
    return radius_m + growth_margin(budget_m)


def detour(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column, lng_c: Column, lat_c: Column) -> Column:
    """How much longer a to b gets by way of c."""
    return haversine(lng_a, lat_a, lng_c, lat_c) + haversine(lng_c, lat_c, lng_b, lat_b) - haversine(lng_a, lat_a, lng_b, lat_b)


def inside_reach(lng: Column, lat: Column, start: tuple[float, float], end: tuple[float, float], most_m: float) -> Column:
    """In the ellipse of places that a walk from start to end of at most this length can touch."""
    a = haversine(lit(start[0]), lit(start[1]), lng, lat)
    b = haversine(lng, lat, lit(end[0]), lit(end[1]))
    return a + b <= lit(most_m)


def reach_circle(start: tuple[float, float], end: tuple[float, float], most_m: float) -> tuple[float, float, float]:
    return (start[0] + end[0]) / 2, (start[1] + end[1]) / 2, max(1.0, most_m / 2)


def perpendicular_offsets(lng1: Column, lat1: Column, lng2: Column, lat2: Column, offset_m: Column, fraction: Column) -> Column:
    """The point at a fraction of a leg, moved sideways by an offset (left positive)."""
    x = (lng2 - lng1) * lit(DEGREE_PLANNER_M) * F.cos(F.radians(lat1))
    y = (lat2 - lat1) * lit(DEGREE_PLANNER_M)
    n = F.sqrt(x * x + y * y)
    px, py = x * fraction - y / n * offset_m, y * fraction + x / n * offset_m
    return F.when(n > 0, F.struct((lng1 + px / (lit(DEGREE_PLANNER_M) * F.cos(F.radians(lat1)))).alias("lng"), (lat1 + py / lit(DEGREE_PLANNER_M)).alias("lat")))


def grid_cell(x: Column, size: float) -> Column:
    return F.floor(x / lit(size)).cast("long")


def line_string_to_json(points: Column) -> Column:
    """GeoJSON text of an array of (lng, lat)."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"])).alias("coordinates")))


def line_string_from_json(text: Column) -> Column:
    parsed = F.from_json(text, "type string, coordinates array<array<double>>")
    return F.transform(parsed["coordinates"], lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))
