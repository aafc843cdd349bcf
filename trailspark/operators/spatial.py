"""Spatial joins on grid cells, and geometry of rings and lines.

A distance alone plans as a nested loop, so every join here is an equi-join on cells with the exact test behind it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import EARTH_M, haversine, lit

#: Less than the shortest degree of latitude, so that boxes are never too small.
SHORT_DEGREE_M = 110_000.0
LEVELS = 12

Keep = Callable[[DataFrame], DataFrame]


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def _band(lat: Column, radius_m: float) -> Column:
    return F.floor(lat / lit(radius_m / SHORT_DEGREE_M)).cast("long")


def _lng_step(band: Column, radius_m: float) -> Column:
    """Degrees of longitude of a band's cells: at least the radius wide anywhere in the band."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)).cast("double") * lit(radius_m / SHORT_DEGREE_M)
    return lit(radius_m / SHORT_DEGREE_M) / F.greatest(F.cos(F.radians(F.least(edge, lit(89.0)))), lit(0.01))


def with_cell(points: DataFrame, radius_m: float, lng: str = "lng", lat: str = "lat") -> DataFrame:
    band = _band(F.col(lat), radius_m)
    return points.withColumn("cell_band", band).withColumn("cell_x", F.floor(F.col(lng) / _lng_step(F.col("cell_band"), radius_m)).cast("long"))


def with_near_cells(points: DataFrame, radius_m: float, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """A row for each cell that may hold something within the radius."""
    own = points.withColumn("cell_band", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: _band(F.col(lat), radius_m) + d)))
    step = _lng_step(F.col("cell_band"), radius_m)
    x = F.floor(F.col(lng) / step).cast("long")
    return own.withColumn("cell_x", F.explode(F.array(x - 1, x, x + 1)))


def range_join(left: DataFrame, right: DataFrame, radius_m: float, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of ``l_*`` and ``r_*`` rows within the radius (inclusive), with their distance ``meters``; both sides have lng and lat."""
    a = with_near_cells(left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]), radius_m, "l_lng", "l_lat")
    b = with_cell(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), radius_m, "r_lng", "r_lat")
    pairs = a.join(b, ["cell_band", "cell_x"]).drop("cell_band", "cell_x")
    if condition is not None:
        pairs = pairs.filter(condition)
    return pairs.withColumn("meters", haversine(F.col("l_lng"), F.col("l_lat"), F.col("r_lng"), F.col("r_lat"))).filter(F.col("meters") <= lit(radius_m))


def all_pairs(points: DataFrame, block: int = 2000) -> DataFrame:
    """``l_*`` and ``r_*`` rows of all pairs of different points of one owner.  points: id, owner and more.

    Points are dealt into blocks and blocks meet in pairs, so a task holds two blocks however many points an owner has, and no pair is shuffled.
    """
    most = points.groupBy("owner").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    k = -(-(most or 1) // block)
    own, every = F.pmod(F.xxhash64("id"), F.lit(k)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))

    def side(mark: str, names: tuple[str, str]) -> DataFrame:
        rows = points.select(*[F.col(c).alias(f"{mark}_{c}") for c in points.columns if c != "owner"], "owner", own.alias(names[0]), every.alias(names[1]))
        return rows.repartition(min(k * k, 4096), "owner", "a", "b") if k > 1 else rows

    return side("l", ("a", "b")).join(side("r", ("b", "a")), ["owner", "a", "b"]).filter("l_id <> r_id").drop("a", "b")


def pairs_within(points: DataFrame, radius_m: float) -> DataFrame:
    """(from_id, to_id, meters): all pairs of different points (id, owner, lng, lat) of one owner within the radius (inclusive; a metre at least).

    For results far larger than the points: chords between places on a unit sphere, which are reckoned once a point, tell who is near; the distance is
    asked only within a millionth of the radius, and else left to whoever reads ``meters``.
    """
    lng, lat = F.radians("lng"), F.radians("lat")
    placed = points.select("id", "owner", "lng", "lat", (F.cos(lat) * F.cos(lng)).alias("u"), (F.cos(lat) * F.sin(lng)).alias("v"), F.sin(lat).alias("w"))
    keys, n = ["owner", "cell_band", "cell_x"], min(4096, 1 + points.count() // 4000)

    def side(mark: str, cells: DataFrame) -> DataFrame:
        return cells.select(*keys, *[F.col(c).alias(f"{mark}_{c}") for c in placed.columns if c != "owner"]).repartition(n, *keys)

    met = side("l", with_near_cells(placed, radius_m)).join(side("r", with_cell(placed, radius_m)), keys)
    u, v, w = (F.col(f"l_{c}") - F.col(f"r_{c}") for c in "uvw")
    chord, most = u * u + v * v + w * w, (2 * math.sin(radius_m / EARTH_M / 2)) ** 2
    meters = haversine(F.col("l_lng"), F.col("l_lat"), F.col("r_lng"), F.col("r_lat"))
    near = (chord <= lit(most * (1 - 1e-6))) | ((chord <= lit(most * (1 + 1e-6))) & (meters <= lit(radius_m)))
    return met.filter((F.col("l_id") != F.col("r_id")) & near).select(F.col("l_id").alias("from_id"), F.col("r_id").alias("to_id"), meters.alias("meters"))


def nearest_neighbours(origins: DataFrame, points: DataFrame, k: int, radius_m: float, keep: Keep = _as_it_is) -> DataFrame:
    """(from_id, to_id, meters, rank): the k nearest of the same owner within the radius, ties by id.  Both sides: id, owner, lng, lat.

    Where cells of the radius hold many points, a smaller radius comes first: who finds k within it needs no larger one.  ``keep`` (a checkpoint) cuts
    the lineage of each radius, as the next one's plan would else hold it several times.
    """
    a, b = origins.select("id", "owner", "lng", "lat"), points.select("id", "owner", "lng", "lat")
    order = Window.partitionBy("l_id").orderBy("meters", "r_id")

    def within(some: DataFrame, radius: float) -> DataFrame:
        pairs = range_join(some, b, radius, (F.col("l_owner") == F.col("r_owner")) & (F.col("l_id") != F.col("r_id")))
        near = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return near.select(F.col("l_id").alias("from_id"), F.col("r_id").alias("to_id"), "meters", "rank")

    out, rest = None, a
    for radius in _radii(b, k, radius_m):
        near = within(rest, radius)
        if radius != radius_m:
            near = keep(near.withColumn("n", F.count("*").over(Window.partitionBy("from_id"))).filter(F.col("n") == k).drop("n"))
            rest = rest.join(near.filter(F.col("rank") == k).select(F.col("from_id").alias("id")), "id", "left_anti")
        out = near if out is None else out.unionByName(near)
    return out


def _radii(points: DataFrame, k: int, radius_m: float) -> list[float]:
    """Radii up to the whole one; the first holds about twice k points of an owner, by the mean crowd around a point."""
    crowd = with_cell(points, radius_m).groupBy("owner", "cell_band", "cell_x").agg(F.count("*").cast("double").alias("n"))
    n, squares = crowd.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    first = radius_m * ((2 * k + 4) * n / (3.14 * squares)) ** 0.5 if n else radius_m
    if first > radius_m / 3:
        return [radius_m]
    return [first, *([3 * first] if 3 * first < radius_m / 3 else []), radius_m]


def affected(existing: DataFrame, new_ids: DataFrame, radius_m: float) -> DataFrame:
    """Ids of the same owner within the radius of a new point, without the new ones."""
    fresh = existing.join(new_ids, "id", "left_semi")
    near = range_join(fresh.select("id", "owner", "lng", "lat"), existing.select("id", "owner", "lng", "lat"), radius_m, F.col("l_owner") == F.col("r_owner"))
    return near.select(F.col("r_id").alias("id")).distinct().join(new_ids, "id", "left_anti")


# ---- rings -----------------------------------------------------------------------------------------------------------


def _edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of a closed or open ring's edges."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["lng"].alias("x1"), p["lat"].alias("y1"), F.element_at(ring, F.pmod(i + 1, n) + 1)["lng"].alias("x2"), F.element_at(ring, F.pmod(i + 1, n) + 1)["lat"].alias("y2")))


def contains(rings: Column, lng: Column, lat: Column) -> Column:
    """Even-odd test over all rings; a point on an edge is outside."""

    def crosses(e: Column) -> Column:
        hit = (e["y1"] > lat) != (e["y2"] > lat)
        return hit & (lng < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(e["y2"] == e["y1"], lit(1)).otherwise(e["y2"] - e["y1"]) + e["x1"])

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lng - e["x1"])
        inside = (lng >= F.least(e["x1"], e["x2"])) & (lng <= F.greatest(e["x1"], e["x2"])) & (lat >= F.least(e["y1"], e["y2"])) & (lat <= F.greatest(e["y1"], e["y2"]))
        return (cross == 0) & inside

    edges = F.flatten(F.transform(rings, _edges))
    count = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0))
    return (F.pmod(count, F.lit(2)) == 1) & ~F.exists(edges, touches)


def signed_area(ring: Column) -> Column:
    """Reckoned from the ring's first point: far from the origin the products' rounding would else decide between areas of one size."""
    x0, y0 = ring[0]["lng"], ring[0]["lat"]
    return F.aggregate(_edges(ring), lit(0), lambda a, e: a + ((e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0))) / 2


def area(rings: Column) -> Column:
    """Square degrees of an outer ring less the holes that follow it."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return sizes[0] - F.aggregate(F.slice(sizes, 2, F.greatest(F.size(sizes) - 1, F.lit(0))), lit(0), lambda a, x: a + x)


def centroid(ring: Column) -> Column:
    """(lng, lat) of a ring's area, reckoned from its first point; of its points' mean where the area is nothing."""
    first = ring[0]
    near = F.transform(ring, lambda p: F.struct((p["lng"] - first["lng"]).alias("lng"), (p["lat"] - first["lat"]).alias("lat")))
    a = signed_area(ring)
    part = lambda axis1, axis2: F.aggregate(_edges(near), lit(0), lambda s, e: s + (e[axis1] + e[axis2]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    mean = lambda f: F.aggregate(near, lit(0), lambda s, p: s + p[f]) / F.size(near)
    return F.struct(
        (first["lng"] + F.when(a != 0, part("x1", "x2") / (6 * a)).otherwise(mean("lng"))).alias("lng"),
        (first["lat"] + F.when(a != 0, part("y1", "y2") / (6 * a)).otherwise(mean("lat"))).alias("lat"),
    )


def box(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["lng"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def expand_box(b: Column, degrees: Column) -> Column:
    return F.struct((b["west"] - degrees).alias("west"), (b["south"] - degrees).alias("south"), (b["east"] + degrees).alias("east"), (b["north"] + degrees).alias("north"))


def polygons_of_points(points: DataFrame, polygons: DataFrame, base_degrees: float = 0.002) -> DataFrame:
    """Pairs of a point (id, lng, lat) with each polygon (osm_id, kind, rings) that contains it, as columns of both.

    Polygons lie in the cells of a grid as coarse as they are large (at most four), points in one cell of each grid: neither side
    grows with the other's extent.
    """
    b = box(F.col("rings"))
    side = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south"))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, lit(1e-12)) / lit(base_degrees))))).cast("int")
    placed = polygons.withColumn("box", b).withColumn("level", level).withColumn("size", lit(base_degrees) * F.pow(lit(2), F.col("level")))
    cells = lambda low, high: F.sequence(F.floor(F.col(low) / F.col("size")).cast("long"), F.floor(F.col(high) / F.col("size")).cast("long"))
    placed = placed.withColumn("cx", F.explode(cells("box.west", "box.east"))).withColumn("cy", F.explode(cells("box.south", "box.north"))).drop("size")
    asked = points.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(LEVELS + 1)])))
    size = lit(base_degrees) * F.pow(lit(2), F.col("level"))
    asked = asked.withColumn("cx", F.floor(F.col("lng") / size).cast("long")).withColumn("cy", F.floor(F.col("lat") / size).cast("long"))
    joined = asked.join(placed, ["level", "cx", "cy"])
    inside = (F.col("lng") >= F.col("box.west")) & (F.col("lng") <= F.col("box.east")) & (F.col("lat") >= F.col("box.south")) & (F.col("lat") <= F.col("box.north"))
    return joined.filter(inside).filter(contains(F.col("rings"), F.col("lng"), F.col("lat"))).drop("level", "cx", "cy", "box")


def _in_cells(polygons: DataFrame, base_degrees: float) -> DataFrame:
    """Polygons (with rings) once for each cell of (level, cx, cy) that they touch: whether an edge may ``cut`` it, and if not, whether they hold it ``whole``.

    Cells are a quarter as large as the polygons at most, so that polygons have cells that they hold whole; where none of their edges' boxes meets a cell,
    its middle decides.
    """
    side = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south"))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, lit(1e-12)) / lit(base_degrees))))).cast("int")
    placed = polygons.withColumn("box", box(F.col("rings"))).withColumn("level", level).withColumn("size", lit(base_degrees / 4) * F.pow(lit(2), F.col("level")))
    cells = lambda low, high: F.sequence(F.floor(F.col(low) / F.col("size")).cast("long"), F.floor(F.col(high) / F.col("size")).cast("long"))
    placed = placed.withColumn("edges", F.flatten(F.transform("rings", _edges))).withColumn("cx", F.explode(cells("box.west", "box.east"))).withColumn("cy", F.explode(cells("box.south", "box.north")))
    # rounding may put a point outside the cell that it is dealt to, so cells are taken a little larger
    low = lambda c: (F.col(c).cast("double") - lit(1e-6)) * F.col("size")
    high = lambda c: (F.col(c).cast("double") + lit(1 + 1e-6)) * F.col("size")
    meets = lambda e: (F.least(e["x1"], e["x2"]) <= high("cx")) & (F.greatest(e["x1"], e["x2"]) >= low("cx")) & (F.least(e["y1"], e["y2"]) <= high("cy")) & (F.greatest(e["y1"], e["y2"]) >= low("cy"))
    middle = lambda c: (F.col(c).cast("double") + lit(0.5)) * F.col("size")
    cut = F.exists("edges", meets)
    whole = F.when(cut, False).otherwise(contains(F.col("rings"), middle("cx"), middle("cy")))
    own = [c for c in polygons.columns if c != "rings"]
    return placed.select("level", "cx", "cy", *own, F.struct(cut.alias("cut"), whole.alias("whole")).alias("f"))


def _at_cells(points: DataFrame, base_degrees: float) -> DataFrame:
    """Points (id, lng, lat) with their cell of each level of ``_in_cells``."""
    asked = points.select("id", "lng", "lat").withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(LEVELS + 1)])))
    size = lit(base_degrees / 4) * F.pow(lit(2), F.col("level"))
    return asked.withColumn("cx", F.floor(F.col("lng") / size).cast("long")).withColumn("cy", F.floor(F.col("lat") / size).cast("long"))


def _kinds_of_cells(polygons: DataFrame, base_degrees: float, keep: Keep = _as_it_is) -> DataFrame:
    """(level, cx, cy, kind, whole, keys): whether a polygon of the kind holds the whole cell, else the polygons that may hold a part of it.

    ``keep`` (a checkpoint) holds them: they are mentioned again and again, and no plan need hold the geometry behind each mention.
    """
    flagged = _in_cells(polygons.select("osm_id", "kind", "rings"), base_degrees)
    found = flagged.groupBy("level", "cx", "cy", "kind").agg(F.bool_or("f.whole").alias("whole"), F.collect_set(F.when(F.col("f.cut"), F.col("osm_id"))).alias("keys"))
    found = keep(found.withColumn("keys", F.when(~F.col("whole"), F.col("keys"))))
    # what lies in a whole cell of a coarser grid adds nothing; whole cells have no keys, but their mention keeps the shuffle common
    wholes = found.filter(F.col("whole") & F.col("keys").isNull()).select(F.col("level").alias("above"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), "kind")
    finer = found.filter(F.col("whole") | F.col("keys").isNotNull()).select("level", "cx", "cy", "kind", F.explode(F.sequence(F.col("level") + 1, F.lit(LEVELS + 1))).alias("above"))
    scale = F.pow(lit(2), F.col("above") - F.col("level"))
    finer = finer.withColumn("ax", F.floor(F.col("cx") / scale).cast("long")).withColumn("ay", F.floor(F.col("cy") / scale).cast("long"))
    covered = finer.join(wholes, ["above", "ax", "ay", "kind"], "left_semi").select("level", "cx", "cy", "kind").distinct()
    return keep(found.join(covered, ["level", "cx", "cy", "kind"], "left_anti"))


def landuse_of_points(points: DataFrame, polygons: DataFrame, base_degrees: float = 0.002, keep: Keep = _as_it_is) -> DataFrame:
    """(id, kind), each once: the kinds of the polygons around a point.  Polygons are known by osm_id and kind.

    Where many polygons of a kind lie over each other, most points get it from one that holds their whole cell; only what is left is tested against rings.
    """
    joined = _at_cells(points, base_degrees).join(_kinds_of_cells(polygons, base_degrees, keep), ["level", "cx", "cy"])
    every = joined.groupBy("id", "kind").agg(F.first("lng").alias("lng"), F.first("lat").alias("lat"), F.bool_or("whole").alias("whole"), F.flatten(F.collect_list("keys")).alias("keys"))
    # a known kind brings one row without a polygon
    every = every.withColumn("osm_id", F.explode_outer(F.when(~F.col("whole"), F.col("keys")))).filter(F.col("whole") | F.col("osm_id").isNotNull())
    rings = polygons.select("osm_id", "kind", "rings")
    tested = every.filter(~F.col("whole")).join(rings, ["osm_id", "kind"]).filter(contains(F.col("rings"), F.col("lng"), F.col("lat"))).select("id", "kind").distinct()
    # points with a cell have a place: its mention keeps both branches' columns, and so their common shuffle, the same
    return every.filter(F.col("whole") & F.col("lng").isNotNull() & F.col("lat").isNotNull()).select("id", "kind").unionByName(tested)


def smallest_around(points: DataFrame, polygons: DataFrame, base_degrees: float = 0.002, keep: Keep = _as_it_is) -> DataFrame:
    """(id, name) of the smallest polygon around a point (then that with the smallest osm_id); polygons: osm_id, kind, name, rings, known by osm_id and kind.

    The smallest polygon that holds a point's whole cell bounds what is asked for: only polygons that cut the cell and come before it are tested.
    """
    ranked = polygons.select(F.struct(area(F.col("rings")).alias("size"), "osm_id", "kind").alias("key"), "rings")
    cells = _in_cells(ranked, base_degrees).groupBy("level", "cx", "cy").agg(F.min(F.when(F.col("f.whole"), F.col("key"))).alias("best"), F.collect_set(F.when(F.col("f.cut"), F.col("key"))).alias("keys"))
    before = lambda keys: F.filter(keys, lambda k: F.col("best").isNull() | (k < F.col("best")))
    cells = keep(cells.withColumn("keys", before("keys")))
    own = _at_cells(points, base_degrees).join(cells, ["level", "cx", "cy"]).groupBy("id").agg(F.first("lng").alias("lng"), F.first("lat").alias("lat"), F.min("best").alias("best"), F.flatten(F.collect_list("keys")).alias("keys"))
    own = keep(own.withColumn("keys", before("keys")))
    asked = own.select("id", "lng", "lat", F.explode("keys").alias("key")).join(ranked, "key")
    tested = asked.filter(contains(F.col("rings"), F.col("lng"), F.col("lat"))).select("id", "key")
    first = own.filter(F.col("best").isNotNull()).select("id", F.col("best").alias("key")).unionByName(tested).groupBy("id").agg(F.min("key").alias("key"))
    return first.select("id", "key.osm_id", "key.kind").join(polygons.select("osm_id", "kind", "name"), ["osm_id", "kind"]).select("id", "name")


# ---- lines -----------------------------------------------------------------------------------------------------------


def closest_on_segment(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """The point of a segment next to (x, y), in planar degrees."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(lit(1), F.greatest(lit(0), ((x - x1) * dx + (y - y1) * dy) / n))).otherwise(lit(0))
    return F.struct((x1 + t * dx).alias("lng"), (y1 + t * dy).alias("lat"))


def join_lines(lines: Column) -> Column:
    """Lines one after the other, without a point that repeats the one before; at least two points."""
    points = F.flatten(lines)
    kept = F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)))))
    return F.when(F.size(kept) == 1, F.concat(kept, kept)).otherwise(kept)


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: indices of the points of a line that stay; none that goes lies farther than the tolerance from the stretch that replaces it."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy, px, py = x[b] - x[a], y[b] - y[a], x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        n = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / n, 0, 1) if n > 0 else 0.0
        far = np.hypot(px - t * dx, py - t * dy)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def _touching(rings: list[tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether edges that aren't neighbours in a ring meet, within a ring or between rings."""
    edges = [np.column_stack([x[:-1], y[:-1], x[1:], y[1:], np.full(len(x) - 1, r), np.arange(len(x) - 1), np.full(len(x) - 1, len(x) - 1)]) for r, (x, y) in enumerate(rings)]
    e = np.concatenate(edges)
    for k in range(len(e) - 1):
        a, o = e[k], e[k + 1 :]
        near = (o[:, 4] == a[4]) & np.isin(o[:, 5] - a[5], (1, a[6] - 1))
        o = o[~near]
        side = lambda p, x, y: (p[..., 2] - p[..., 0]) * (y - p[..., 1]) - (p[..., 3] - p[..., 1]) * (x - p[..., 0])
        apart = side(a, o[:, 0], o[:, 1]) * side(a, o[:, 2], o[:, 3]) > 0
        apart |= side(o, a[0], a[1]) * side(o, a[2], a[3]) > 0
        low, high = np.minimum(o[:, :2], o[:, 2:4]), np.maximum(o[:, :2], o[:, 2:4])
        apart |= (low > np.maximum(a[:2], a[2:4])).any(axis=1) | (high < np.minimum(a[:2], a[2:4])).any(axis=1)
        if not apart.all():
            return True
    return False


def _inside(rings: list[tuple[np.ndarray, np.ndarray]]) -> list[bool]:
    """For each pair of rings whether the first point of one lies in the other."""
    out = []
    for a, (px, py) in enumerate(rings):
        for b, (x, y) in enumerate(rings):
            if a != b:
                over = (y[:-1] > py[0]) != (y[1:] > py[0])
                at = x[:-1][over] + (py[0] - y[:-1][over]) / (y[1:][over] - y[:-1][over]) * (x[1:][over] - x[:-1][over])
                out.append(bool(np.count_nonzero(at > px[0]) % 2))
    return out


def kept_of_rings(rings: list[tuple[np.ndarray, np.ndarray]], tolerance: float) -> list[np.ndarray]:
    """Indices of the points of closed rings that stay: at least a triangle of each, and with less tolerance where edges would meet or a ring leave another."""
    every = [np.arange(len(x)) for x, _ in rings]
    if any(len(x) < 4 for x, _ in rings) or _touching(rings):
        return every
    while tolerance > 0:
        kept = []
        for x, y in rings:
            far = int(np.argmax(np.hypot(x - x[0], y - y[0])))
            k = np.concatenate([kept_points(x[: far + 1], y[: far + 1], tolerance), far + kept_points(x[far:], y[far:], tolerance)[1:]]) if 0 < far < len(x) - 1 else np.arange(len(x))
            if len(k) < 4:
                dx, dy = x[far] - x[0], y[far] - y[0]
                third = int(np.argmax(np.abs(dx * (y - y[0]) - dy * (x - x[0]))))
                k = np.unique([0, far, third, len(x) - 1])
            kept.append(k)
        new = [(x[k], y[k]) for (x, y), k in zip(rings, kept, strict=True)]
        if not _touching(new) and _inside(new) == _inside(rings):
            return kept
        tolerance = tolerance / 2 if tolerance > 1e-12 else 0.0
    return every


def simplify(points: Column, tolerance: Column | float) -> Column:
    """A line's points without those that lie within the tolerance (degrees) of the stretch that replaces them; ends stay.

    Which point goes next depends on those that stayed, so the indices come from an Arrow batch; the points don't leave the JVM's column.
    """

    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kept_points(np.asarray(x, float), np.asarray(y, float), t).tolist() if len(x) > 2 else list(range(len(x))) for x, y, t in zip(xs, ys, by, strict=True)])

    by = tolerance if isinstance(tolerance, Column) else lit(tolerance)
    k = kept(F.transform(points, lambda p: p["lng"]), F.transform(points, lambda p: p["lat"]), by)
    return F.transform(k, lambda i: F.element_at(points, i + 1))


def simplify_rings(rings: Column, tolerance: Column | float) -> Column:
    """Closed rings likewise; edges don't come to meet, and no ring becomes less than a triangle.  Rings whose edges meet already stay as they are."""

    @F.pandas_udf("array<array<int>>")
    def kept(xs: pd.Series, ys: pd.Series, by: pd.Series) -> pd.Series:
        pairs = lambda x, y: [(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, y, strict=True)]
        return pd.Series([None if x is None else [k.tolist() for k in kept_of_rings(pairs(x, y), t)] if len(x) else [] for x, y, t in zip(xs, ys, by, strict=True)])

    by = tolerance if isinstance(tolerance, Column) else lit(tolerance)
    axis = lambda name: F.transform(rings, lambda r: F.transform(r, lambda p: p[name]))
    k = kept(axis("lng"), axis("lat"), by)
    return F.transform(F.arrays_zip(rings.alias("r"), k.alias("k")), lambda z: F.transform(z["k"], lambda i: F.element_at(z["r"], i + 1)))


def nearest_place(points: DataFrame, places: DataFrame, areas: DataFrame, town_m: float = 8000, village_m: float = 4000, keep: Keep = _as_it_is) -> DataFrame:
    """(id, label): the smallest park or forest with a name around a point, else the next town, else the next village or suburb."""
    named = areas.filter(F.col("kind").isin("park", "forest") & F.col("name").isNotNull())
    by_area = smallest_around(points, named.select("osm_id", "kind", "name", "rings"), keep=keep).withColumnRenamed("name", "by_area")

    def next_of(kinds: tuple[str, ...], radius: float, name: str) -> DataFrame:
        # places are few: it is they that take the cells around them
        near = range_join(places.filter(F.col("place").isin(*kinds)).select("osm_id", "name", "lng", "lat"), points.select("id", "lng", "lat"), radius)
        return near.groupBy(F.col("r_id").alias("id")).agg(F.min_by("l_name", F.struct("meters", "l_osm_id")).alias(name))

    towns, villages = next_of(("city", "town"), town_m, "by_town"), next_of(("village", "hamlet", "suburb"), village_m, "by_village")
    joined = points.select("id").join(by_area, "id", "left").join(towns, "id", "left").join(villages, "id", "left")
    return joined.select("id", F.coalesce("by_area", "by_town", "by_village").alias("label"))


def snap_to_roads(path: DataFrame, roads: DataFrame, radius_m: float, most: int = 20) -> DataFrame:
    """(lng, lat, osm_id, meters): per road the point next to the path's points (lng, lat), nearest first, one for each five-digit place.

    Segments longer than the radius are found through the cells of all points along them.
    """
    step = radius_m / 111_320.0
    seg = roads.select("osm_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("line") - 1, F.lit(1))), lambda i: F.struct(F.element_at("line", i).alias("a"), F.element_at("line", F.least(i + 1, F.size("line"))).alias("b")))).alias("s"))
    pieces = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("s.b.lng") - F.col("s.a.lng"), F.col("s.b.lat") - F.col("s.a.lat")) / lit(step)).cast("int"))
    along = seg.withColumn("n", pieces).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n")))).select(
        "osm_id", "s", (F.col("s.a.lng") + (F.col("s.b.lng") - F.col("s.a.lng")) * F.col("t") / F.col("n")).alias("lng"), (F.col("s.a.lat") + (F.col("s.b.lat") - F.col("s.a.lat")) * F.col("t") / F.col("n")).alias("lat")
    )
    near = range_join(path.select("lng", "lat"), along, 2 * radius_m).select("l_lng", "l_lat", "r_osm_id", "r_s").distinct()
    q = closest_on_segment(F.col("r_s.a.lng"), F.col("r_s.a.lat"), F.col("r_s.b.lng"), F.col("r_s.b.lat"), F.col("l_lng"), F.col("l_lat"))
    found = near.withColumn("q", q).withColumn("meters", haversine(F.col("l_lng"), F.col("l_lat"), F.col("q.lng"), F.col("q.lat"))).filter(F.col("meters") <= lit(radius_m))
    best = found.groupBy("r_osm_id").agg(F.min_by(F.struct("q", "meters"), F.struct("meters", "q")).alias("b"))
    place = lambda c: F.floor(F.col(c) * 100_000 + 0.5)
    one = Window.partitionBy(place("lng"), place("lat")).orderBy("meters", "osm_id")
    rows = best.select(F.col("r_osm_id").alias("osm_id"), F.col("b.q.lng").alias("lng"), F.col("b.q.lat").alias("lat"), F.col("b.meters").alias("meters"))
    return rows.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n").orderBy("meters", "osm_id").limit(most)
