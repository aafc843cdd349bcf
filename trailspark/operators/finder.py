"""The cache finder: filters that compose, and the columns that go with a found cache."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.geo import haversine, lit, round_up
from trailspark.functions.text import multi_class, needs_tool
from trailspark.operators.spatial import SHORT_DEGREE_M


@dataclass
class Find:
    owner: int
    center: tuple[float, float] | None = None
    radius_m: float = 0
    types: list[str] = field(default_factory=list)
    difficulty: tuple[float, float] | None = None
    terrain: tuple[float, float] | None = None
    solved_only: bool = False
    show_archived: bool = False
    show_disabled: bool = False
    hide_tools: bool = False
    multi_classes: list[str] = field(default_factory=list)
    attribute_groups: list[list[tuple[int, bool]]] = field(default_factory=list)
    landuse_kinds: list[str] = field(default_factory=list)


def within(lng: Column, lat: Column, center: tuple[float, float], radius_m: float) -> Column:
    """A box that reaches the scan, right on both axes, and the exact distance behind it."""
    import math

    dlat = radius_m / SHORT_DEGREE_M
    dlng = dlat / max(0.01, math.cos(math.radians(min(89.0, abs(center[1]) + dlat))))
    in_box = lng.between(center[0] - dlng, center[0] + dlng) & lat.between(center[1] - dlat, center[1] + dlat)
    return in_box & (haversine(lng, lat, lit(center[0]), lit(center[1])) <= lit(radius_m))


def rated(value: Column, low: float, high: float) -> Column:
    """A missing rating passes."""
    return value.isNull() | value.between(low, high)


def has_attributes(attributes: Column, groups: list[list[tuple[int, bool]]]) -> Column:
    """For each group (empty ones aside) one of its (id, positive) is among the attributes."""
    test = F.lit(True)
    for group in groups:
        if group:
            wanted = [(F.lit(i), F.lit(p)) for i, p in group]
            one = lambda a, wanted=wanted: F.greatest(*[((a["attr_id"] == i) & (a["positive"] == p)) for i, p in wanted], F.lit(False))
            test = test & F.coalesce(F.exists(attributes, lambda a: one(a)), F.lit(False))
    return test


def find(caches: DataFrame, p: Find, finds: DataFrame | None = None, user: int | None = None, excluded: DataFrame | None = None, landuse: DataFrame | None = None) -> DataFrame:
    """Caches that pass all filters.  ``landuse`` is (id, kind), ``excluded`` has id, ``finds`` (cache_id, user_id)."""
    out = caches.filter(F.col("owner") == p.owner)
    if p.center is not None:
        out = out.filter(within(F.col("lng"), F.col("lat"), p.center, p.radius_m))
    if not p.show_archived:
        out = out.filter(~F.col("archived"))
    if not p.show_disabled:
        out = out.filter(~F.col("disabled"))
    if p.types:
        out = out.filter(F.col("type").isin(*p.types))
    if p.difficulty:
        out = out.filter(rated(F.col("difficulty"), *p.difficulty))
    if p.terrain:
        out = out.filter(rated(F.col("terrain"), *p.terrain))
    if p.solved_only:
        out = out.filter(~((F.col("type") == "Mystery") & ~F.col("solved")))
    if p.attribute_groups:
        out = out.filter(has_attributes(F.col("attributes"), p.attribute_groups))
    if p.hide_tools:
        out = out.filter(~needs_tool(F.transform(F.filter("attributes", lambda a: a["positive"]), lambda a: a["attr_id"]), F.col("description_hints")))
    if p.multi_classes:
        out = out.filter((F.col("type") != "Multi") | multi_class(F.col("stage_count")).isin(*p.multi_classes))
    if finds is not None and user is not None:
        seen = finds.filter(F.col("user_id") == user).select(F.col("cache_id").alias("id"))
        out = out.join(seen, "id", "left_anti")
    if excluded is not None:
        out = out.join(excluded.select("id"), "id", "left_anti")
    if landuse is not None and p.landuse_kinds:
        out = out.join(landuse.filter(F.col("kind").isin(*p.landuse_kinds)).select("id"), "id", "left_semi")
    return out


def with_details(caches: DataFrame, attributes: DataFrame, waypoints: DataFrame, finds: DataFrame, user: int) -> DataFrame:
    """Each cache with attribute_ids (positive, in order), parking points, stage count and whether the user found it; each side is aggregated before it joins."""
    a = attributes.groupBy(F.col("cache_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("positive"), F.col("attr_id")))).alias("attribute_ids")
    )
    w = waypoints.groupBy(F.col("cache_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "parking", F.struct("lng", "lat")))).alias("parking"), F.count_if(F.col("type") == "stages").alias("stage_count")
    )
    f = finds.filter(F.col("user_id") == user).select(F.col("cache_id").alias("id"), F.lit(True).alias("found")).distinct()
    joined = caches.join(a, "id", "left").join(w, "id", "left").join(f, "id", "left")
    return joined.withColumns({
        "attribute_ids": F.coalesce("attribute_ids", F.array().cast("array<int>")), "parking": F.coalesce("parking", F.array().cast("array<struct<lng:double,lat:double>>")),
        "stage_count": F.coalesce("stage_count", F.lit(0)), "found": F.coalesce("found", F.lit(False)),
    })


def summary(caches: DataFrame) -> DataFrame:
    """The fields that lists show."""
    return caches.select("id", "code", "type", "name", "lng", "lat", "difficulty", "terrain", needs_tool(F.col("attribute_ids"), F.col("description_hints")).alias("requires_tool"))


def cluster_hint(caches: DataFrame) -> DataFrame:
    """Counts on a grid of hundredths of a degree."""
    return caches.groupBy(round_up(F.col("lng"), 2).alias("glng"), round_up(F.col("lat"), 2).alias("glat")).agg(F.count("*").alias("n"))


def parking_matches(access: Column, fee: Column, accepted: list[str] | None, wanted_fee: str = "any") -> Column:
    test = ~access.eqNullSafe(F.lit("private"))
    if accepted:
        test = test & access.isin(*accepted)
    if wanted_fee == "free":
        test = test & (fee.isNull() | (fee == "no"))
    elif wanted_fee == "paid":
        test = test & (fee == "yes")
    return F.coalesce(test, F.lit(False))


def road_eligible(highway: Column, access: Column, motor: Column, speed: Column, service: Column) -> Column:
    from trailspark.functions.text import ROAD_CLASSES

    open_to = lambda c: c.isNull() | ~c.isin("no", "private")
    return highway.isin(*ROAD_CLASSES) & open_to(access) & open_to(motor) & (speed.isNull() | (speed < 70)) & (service.isNull() | (service != "driveway"))


def stale(state: Column, version: Column, wanted: str, fetched: Column, now: Column, ttl_days: int) -> Column:
    """Missing, in a state to be redone, of another version, never fetched, or fetched too long ago."""
    return (
        state.isNull() | state.isin("missing", "pending", "failed") | ~version.eqNullSafe(F.lit(wanted)) | fetched.isNull()
        | (fetched < now - F.make_interval(days=F.lit(ttl_days)))
    )


def visible(owner: Column, user: int) -> Column:
    return owner.isNull() | (owner == user)


def by_ids(caches: DataFrame, ids: DataFrame, owner: int) -> DataFrame:
    return caches.filter(F.col("owner") == owner).join(ids, "id", "left_semi")


def wide_enough(width: Column, height: Column, tolerance: float, times: float) -> Column:
    return (width > lit(tolerance * times)) & (height > lit(tolerance * times))


MOST_DEGREES = 2.5


def check_box(west: float, south: float, east: float, north: float) -> None:
    if east - west > MOST_DEGREES or north - south > MOST_DEGREES:
        raise ValueError(f"a box of over {MOST_DEGREES} degrees")
