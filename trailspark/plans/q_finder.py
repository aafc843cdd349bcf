"""Queries of filters (FLT), the cache finder, and the columns that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.operators import finder as X
from trailspark.operators.spatial import landuse_of_points
from trailspark.plans.bindings import entity, load, metres, polygons, register, scalar, sql_cents

C = F.col
CENTER = (5.1, 52.1)
_C = "(SELECT 5.1e0 AS lng, 52.1e0 AS lat)"
_NEAR = f"{metres('caches', 'c')} <= {{}}"


@register("finder_grid", f"""
    SELECT floor(caches.lng * 100 + 0.5) / 100 AS glng, floor(caches.lat * 100 + 0.5) / 100 AS glat, count(*) AS n FROM caches, {_C} c
    WHERE {_NEAR.format(9000)} AND type IN ('Traditional', 'Multi', 'Mystery') AND (difficulty IS NULL OR difficulty BETWEEN 1.5 AND 4) AND NOT archived AND NOT disabled GROUP BY 1, 2""")
def finder_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: filters by place, type and rating with the counts of a grid (over all owners)."""
    rows = entity(spark, sf, "caches").filter(~C("archived") & ~C("disabled")).filter(C("type").isin("Traditional", "Multi", "Mystery"))
    rows = rows.filter(X.within(C("lng"), C("lat"), CENTER, 9000)).filter(X.rated(C("difficulty"), 1.5, 4))
    return X.cluster_hint(rows)


def _simple(name: str, where: str, keep) -> None:
    @register(name, f"SELECT id, owner FROM caches WHERE {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return keep(entity(spark, sf, "caches")).select("id", "owner")


_simple("flt01_owner", "owner = 3 AND NOT archived AND NOT disabled", lambda d: X.find(d, X.Find(3)))
_simple("flt03_flags", "owner = 3", lambda d: X.find(d, X.Find(3, show_archived=True, show_disabled=True)))
_simple("flt07_types", "owner = 4 AND type IN ('Multi', 'Virtual') AND NOT archived AND NOT disabled", lambda d: X.find(d, X.Find(4, types=["Multi", "Virtual"])))
_simple("flt08_ratings", "owner = 5 AND (difficulty IS NULL OR difficulty BETWEEN 2 AND 3.5) AND (terrain IS NULL OR terrain BETWEEN 1 AND 4) AND NOT archived AND NOT disabled", lambda d: X.find(d, X.Find(5, difficulty=(2, 3.5), terrain=(1, 4))))
_simple("flt09_solved", "owner = 6 AND NOT (type = 'Mystery' AND NOT solved) AND NOT archived AND NOT disabled", lambda d: X.find(d, X.Find(6, solved_only=True)))
_simple("flt12_multi", "owner = 7 AND (type <> 'Multi' OR stage_count BETWEEN 1 AND 2) AND NOT archived AND NOT disabled", lambda d: X.find(d, X.Find(7, multi_classes=["mini"])))
_simple("flt21_stages", "owner = 8 AND adventure_id IN ('adv8-a', 'adv8-b') AND NOT archived", lambda d: d.filter((C("owner") == 8) & C("adventure_id").isin("adv8-a", "adv8-b") & ~C("archived")))
_simple("flt22_missing_adventure", "type = 'Adventure Lab' AND stage_sequence IS NOT NULL AND nullif(CASE WHEN id % 4 = 2 THEN '' ELSE adventure_id END, '') IS NULL", lambda d: d.withColumn("a", F.when(C("id") % 4 == 2, "").otherwise(C("adventure_id"))).filter((C("type") == "Adventure Lab") & C("stage_sequence").isNotNull() & (C("a").isNull() | (C("a") == ""))))
_simple("flt23_exists", "owner = 9 AND id = (SELECT min(id) FROM caches WHERE owner = 9)", lambda d: d.filter(C("owner") == 9).join(d.filter(C("owner") == 9).agg(F.min("id").alias("id")), "id", "left_semi"))


@register("flt02_radius", f"SELECT id, {sql_cents(metres('caches', 'c'))} AS meters FROM caches, {_C} c WHERE {_NEAR.format(3000)}")
def flt02(spark: SparkSession, sf: str) -> DataFrame:
    from trailspark.functions.geo import haversine, lit
    from trailspark.plans.bindings import cents

    rows = entity(spark, sf, "caches").filter(X.within(C("lng"), C("lat"), CENTER, 3000))
    return rows.select("id", cents(haversine(C("lng"), C("lat"), lit(CENTER[0]), lit(CENTER[1]))).alias("meters"))


@register("flt04_not_found", "SELECT id, owner FROM caches WHERE owner = 3 AND NOT archived AND NOT disabled AND NOT EXISTS (SELECT 1 FROM finds WHERE finds.cache_id = caches.id AND finds.user_id = 2)")
def flt04(spark: SparkSession, sf: str) -> DataFrame:
    return X.find(entity(spark, sf, "caches"), X.Find(3), finds=entity(spark, sf, "finds"), user=2).select("id", "owner")


@register("flt05_excluded", "SELECT id, owner FROM caches WHERE owner = 3 AND NOT archived AND NOT disabled AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def flt05(spark: SparkSession, sf: str) -> DataFrame:
    saved = load(spark, sf, "orders").filter(C("o_orderkey") % 3 == 0).select(C("o_custkey").alias("id"))
    return X.find(entity(spark, sf, "caches"), X.Find(3), excluded=saved).select("id", "owner")


_IN = "caches.lng > l.west AND caches.lng < l.east AND caches.lat > l.south AND caches.lat < l.north"


@register("flt06_landuse", f"SELECT id, owner FROM caches WHERE owner = 3 AND NOT archived AND NOT disabled AND EXISTS (SELECT 1 FROM landuse l WHERE kind IN ('forest', 'park') AND {_IN})")
def flt06(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    p = X.Find(3, landuse_kinds=["forest", "park"])
    pool = caches.filter(C("owner") == 3)
    return X.find(caches, p, landuse=landuse_of_points(pool.select("id", "lng", "lat"), polygons(spark, sf))).select("id", "owner")


@register("flt10_attributes", """
    SELECT id, owner FROM caches WHERE owner < 6 AND NOT archived AND NOT disabled
    AND EXISTS (SELECT 1 FROM attributes a WHERE a.cache_id = caches.id AND ((attr_id = 10 AND positive) OR (attr_id = 20 AND positive) OR (attr_id = 0 AND NOT positive)))
    AND EXISTS (SELECT 1 FROM attributes a WHERE a.cache_id = caches.id AND ((attr_id = 30 AND positive) OR (attr_id = 40 AND NOT positive)))""")
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    rows = entity(spark, sf, "attributes").groupBy(C("cache_id").alias("id")).agg(F.collect_list(F.struct("attr_id", "positive")).alias("attributes"))
    caches = entity(spark, sf, "caches").filter(C("owner") < 6).filter(~C("archived") & ~C("disabled")).join(rows, "id")
    groups = [[(10, True), (20, True), (0, False)], [], [(30, True), (40, False)]]
    return caches.filter(X.has_attributes(C("attributes"), groups)).select("id", "owner")


@register("flt11_no_tools", "SELECT id, owner FROM caches WHERE owner < 9 AND NOT archived AND NOT disabled AND NOT EXISTS (SELECT 1 FROM attributes a WHERE a.cache_id = caches.id AND positive AND attr_id IN (3, 4, 5, 11, 12, 44, 48, 49, 50, 51, 64, 20))")
def flt11(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute 20 stands in for a tool here: the driver's derived attributes are multiples of ten."""
    from trailspark.functions.text import needs_tool

    rows = entity(spark, sf, "attributes").filter("positive").groupBy(C("cache_id").alias("id")).agg(F.collect_list(F.when(C("attr_id") == 20, 51).otherwise(C("attr_id"))).alias("ids"))
    caches = entity(spark, sf, "caches").filter((C("owner") < 9) & ~C("archived") & ~C("disabled")).join(rows, "id", "left")
    return caches.filter(~needs_tool(F.coalesce("ids", F.array().cast("array<int>")), F.array().cast("array<string>"))).select("id", "owner")


scalar("flt13_parking", "parking", {
    "any": (lambda: X.parking_matches(C("access"), C("fee"), None), "access IS DISTINCT FROM 'private'"),
    "free": (lambda: X.parking_matches(C("access"), C("fee"), ["yes", "customers"], "free"), "coalesce(access IN ('yes', 'customers'), false) AND coalesce(fee, 'no') = 'no'"),
    "paid": (lambda: X.parking_matches(C("access"), C("fee"), None, "paid"), "access IS DISTINCT FROM 'private' AND coalesce(fee, '') = 'yes'"),
})
_ROADS = "CASE id % 7 WHEN 0 THEN 'residential' WHEN 1 THEN 'motorway' WHEN 2 THEN 'service' ELSE 'tertiary' END"
scalar("flt14_roads", "caches", {
    "eligible": (lambda: X.road_eligible(F.expr(_ROADS), F.expr("CASE id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'yes' END"), F.expr("CASE id % 3 WHEN 0 THEN 'no' END"), F.expr("CASE WHEN id % 4 > 0 THEN id % 90 END"), F.expr("CASE id % 6 WHEN 0 THEN 'driveway' WHEN 1 THEN 'alley' END")),
                 "id % 7 <> 1 AND id % 5 <> 0 AND id % 3 <> 0 AND (id % 4 = 0 OR id % 90 < 70) AND id % 6 <> 0"),
})
scalar("flt15_min_side", "landuse", {
    "landuse": (lambda: X.wide_enough(C("east") - C("west"), C("north") - C("south"), 0.0012, 2), "least(osm_id % 9, osm_id % 7) >= 2"),
    "parking": (lambda: X.wide_enough(C("east") - C("west"), C("north") - C("south"), 0.0012, 4), "least(osm_id % 9, osm_id % 7) >= 4"),
}, keys="osm_id")


@register("flt16_box", "SELECT osm_id, kind FROM landuse WHERE west <= 5.1 AND east >= 5.05 AND south <= 52.1 AND north >= 52.05")
def flt16(spark: SparkSession, sf: str) -> DataFrame:
    from trailspark.operators.spatial import box, boxes_overlap

    X.check_box(5.05, 52.05, 5.1, 52.1)
    asked = F.struct(F.lit(5.05).alias("west"), F.lit(52.05).alias("south"), F.lit(5.1).alias("east"), F.lit(52.1).alias("north"))
    return polygons(spark, sf).filter(boxes_overlap(box(C("rings")), asked)).select("osm_id", "kind")


scalar("flt17_suspicious", "pairs", {
    "bad": (lambda: __import__("trailspark.functions.planning", fromlist=["x"]).suspicious_leg((C("id") % 9).cast("double"), (C("id") % 80).cast("double")), "id % 9 <= 5 AND id % 80 >= 50"),
})
_STALE = "state IS NULL OR state IN ('missing', 'pending', 'failed') OR osrm_version IS DISTINCT FROM 'v1' OR fetched_at IS NULL OR fetched_at < timestamp '1998-01-01' - INTERVAL 365 DAY"


@register("flt18_stale", f"SELECT cache_id, kind, {_STALE} AS stale FROM states")
def flt18(spark: SparkSession, sf: str) -> DataFrame:
    test = X.stale(C("state"), C("osrm_version"), "v1", C("fetched_at"), F.expr("timestamp '1998-01-01'"), 365)
    return entity(spark, sf, "states").select("cache_id", "kind", test.alias("stale"))


scalar("flt19_visible", "caches", {"visible": (lambda: X.visible(F.when(C("id") % 5 > 0, C("owner")), 3), "id % 5 = 0 OR owner = 3")})


@register("flt20_by_ids", "SELECT id, name, code FROM caches WHERE owner = 3 AND id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def flt20(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf, "orders").filter(C("o_orderkey") % 5 == 0).select(C("o_custkey").alias("id"))
    return X.by_ids(entity(spark, sf, "caches"), ids, 3).select("id", "name", "code")


@register("flt24_coords", "SELECT id, lng, lat FROM caches WHERE owner = 11 AND id IN (SELECT o_custkey FROM orders)")
def flt24(spark: SparkSession, sf: str) -> DataFrame:
    return X.by_ids(entity(spark, sf, "caches"), load(spark, sf, "orders").select(C("o_custkey").alias("id")), 11).select("id", "lng", "lat")


@register("flt25_stale_ids", f"SELECT cache_id FROM states WHERE kind = 'walking' AND ({_STALE}) ORDER BY cache_id LIMIT 40")
def flt25(spark: SparkSession, sf: str) -> DataFrame:
    test = X.stale(C("state"), C("osrm_version"), "v1", C("fetched_at"), F.expr("timestamp '1998-01-01'"), 365)
    return entity(spark, sf, "states").filter((C("kind") == "walking") & test).orderBy("cache_id").limit(40).select("cache_id")


@register("flt26_by_email", "SELECT c_custkey AS id FROM customer WHERE lower(concat(c_name, '@Example.com')) = lower('CUSTOMER#000000007@example.com')")
def flt26(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").filter(F.lower(F.concat("c_name", F.lit("@Example.com"))) == F.lower(F.lit("CUSTOMER#000000007@example.com"))).select(C("c_custkey").alias("id"))


@register("jn15_details", """
    SELECT id, (SELECT coalesce(string_agg(CAST(attr_id AS VARCHAR), ',' ORDER BY attr_id), '') FROM attributes a WHERE a.cache_id = caches.id AND positive) AS attribute_ids,
           (SELECT count(*) FROM waypoints w WHERE w.cache_id = caches.id AND w.type = 'parking') AS n_parking, (SELECT count(*) FROM waypoints w WHERE w.cache_id = caches.id AND w.type = 'stages') AS stages,
           EXISTS (SELECT 1 FROM finds WHERE finds.cache_id = caches.id AND finds.user_id = 3) AS found FROM caches""")
def jn15(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_details(entity(spark, sf, "caches").drop("stage_count"), *[entity(spark, sf, n) for n in ("attributes", "waypoints", "finds")], user=3)
    return rows.select("id", F.array_join(C("attribute_ids").cast("array<string>"), ",").alias("attribute_ids"), F.size("parking").cast("long").alias("n_parking"), C("stage_count").alias("stages"), "found")


@register("fn41_summary", "SELECT id, code, type, name, lng, lat, difficulty, terrain, id % 70 = 3 OR id % 6 = 0 AS requires_tool FROM caches")
def fn41(spark: SparkSession, sf: str) -> DataFrame:
    rows = entity(spark, sf, "caches").withColumns({"attribute_ids": F.array(F.when(C("id") % 70 == 3, 3).otherwise(1)), "description_hints": F.when(C("id") % 6 == 0, F.array(F.lit("mirror"))).otherwise(F.array().cast("array<string>"))})
    return X.summary(rows)


@register("ag07_grid", "SELECT floor(lng * 100 + 0.5) / 100 AS glng, floor(lat * 100 + 0.5) / 100 AS glat, count(*) AS n FROM caches GROUP BY 1, 2")
def ag07(spark: SparkSession, sf: str) -> DataFrame:
    return X.cluster_hint(entity(spark, sf, "caches"))
