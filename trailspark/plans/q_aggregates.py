"""Queries of aggregations (AG), windows (WN), order and limits (TK), and set operations (SO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import haversine, lit
from trailspark.operators import aggregates as A
from trailspark.operators import scoring
from trailspark.plans import tours
from trailspark.plans.bindings import cents, entity, load, metres, register, sql_cents
from trailspark.plans.q_spatial import _VIEW, SQL_LEGS, make_legs

C = F.col


@register("ag01_attribute_ids", "SELECT cache_id, coalesce(string_agg(CAST(attr_id AS VARCHAR), ',' ORDER BY attr_id) FILTER (WHERE positive), '') AS ids FROM attributes GROUP BY cache_id")
def ag01(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.sort_array(F.collect_list(F.when(C("positive"), C("attr_id"))))
    return entity(spark, sf, "attributes").groupBy("cache_id").agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@register("ag02_parking_points", f"SELECT cache_id, count(*) AS n, floor(sum(floor(lng * 50000 + 0.5))) AS lng, floor(sum(floor(lat * 50000 + 0.5))) AS lat FROM waypoints WHERE type = 'parking' GROUP BY cache_id")
def ag02(spark: SparkSession, sf: str) -> DataFrame:
    w = entity(spark, sf, "waypoints").filter(C("type") == "parking").groupBy("cache_id").agg(F.sort_array(F.collect_list(F.struct("lng", "lat"))).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda s, x: s + F.floor(x[f] * 50_000 + 0.5).cast("double"))
    return w.select("cache_id", F.size("p").cast("long").alias("n"), total("lng").alias("lng"), total("lat").alias("lat"))


@register("ag03_stages", "SELECT cache_id, count(*) FILTER (WHERE type = 'stages') AS stages FROM waypoints GROUP BY cache_id")
def ag03(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "waypoints").groupBy("cache_id").agg(F.count_if(C("type") == "stages").alias("stages"))


_BUCKET = "CASE WHEN state = 'missing' THEN 'missing' WHEN state <> 'fresh' THEN state WHEN osrm_version IS DISTINCT FROM 'v1' THEN 'outdated' ELSE 'fresh' END"
_BUCKETS = ["missing", "pending", "failed", "outdated", "fresh", "unknown"]


@register("ag04_freshness", f"""
    SELECT k.kind, b.bucket, count(v.id) AS n FROM (VALUES ('walking'), ('landuse')) k(kind) CROSS JOIN (VALUES {', '.join(f"('{b}')" for b in _BUCKETS)}) b(bucket)
    LEFT JOIN (SELECT id, kind, {_BUCKET} AS bucket FROM ({_VIEW})) v ON v.kind = k.kind AND v.bucket = b.bucket GROUP BY 1, 2""")
def ag04(spark: SparkSession, sf: str) -> DataFrame:
    view = A.state_view(entity(spark, sf, "caches"), entity(spark, sf, "states"))
    return A.freshness(view, F.expr(_BUCKET.replace("osrm_version IS DISTINCT FROM 'v1'", "NOT (osrm_version <=> 'v1')")), _BUCKETS, ["walking", "landuse"])


@register("ag05_adventure_freshness", f"SELECT {_BUCKET} AS bucket, count(*) AS n, (SELECT count(*) FROM caches WHERE type = 'Adventure Lab') AS total FROM ({_VIEW}) v WHERE kind = 'walking' AND id IN (SELECT id FROM caches WHERE type = 'Adventure Lab') GROUP BY 1")
def ag05(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    labs = caches.filter(C("type") == "Adventure Lab")
    view = A.state_view(labs, entity(spark, sf, "states")).filter(C("kind") == "walking")
    by = view.groupBy(F.expr(_BUCKET.replace("osrm_version IS DISTINCT FROM 'v1'", "NOT (osrm_version <=> 'v1')")).alias("bucket")).agg(F.count("*").alias("n"))
    return by.crossJoin(labs.agg(F.count("*").alias("total")))  # one row


@register("ag06_incomplete_pairs", f"""
    WITH s AS (SELECT id, adventure_id FROM caches WHERE adventure_id IS NOT NULL), k AS (SELECT adventure_id, count(*) AS k FROM s GROUP BY 1 HAVING count(*) >= 2),
    h AS (SELECT a.adventure_id, count(*) AS n FROM ({SQL_LEGS}) l JOIN s a ON a.id = l.from_id JOIN s b ON b.id = l.to_id AND a.adventure_id = b.adventure_id GROUP BY 1)
    SELECT DISTINCT id FROM s JOIN k USING (adventure_id) LEFT JOIN h USING (adventure_id) WHERE coalesce(n, 0) < k * (k - 1) ORDER BY id LIMIT 100""")
def ag06(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    stages = caches.filter("adventure_id IS NOT NULL")  # other legs join no stage
    return A.incomplete_pairs(stages.select("id", "adventure_id"), make_legs(stages)).orderBy("id").limit(100)


_OUTCOME = "CASE id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'updated' ELSE 'stale' END"


@register("ag08_upload_stats", f"SELECT owner AS upload_id, count(*) AS parsed, count(*) FILTER ({_OUTCOME} = 'new') AS created, count(*) FILTER ({_OUTCOME} = 'updated') AS updated, count(*) FILTER ({_OUTCOME} = 'stale') AS stale, count(*) FILTER (disabled) AS disabled, count(*) FILTER (archived) AS archived FROM caches GROUP BY owner")
def ag08(spark: SparkSession, sf: str) -> DataFrame:
    return A.upload_stats(entity(spark, sf, "caches").select(C("owner").alias("upload_id"), F.expr(_OUTCOME).alias("outcome"), "disabled", "archived"))


@register("ag08b_by_type", "SELECT owner, type, count(*) AS n FROM caches GROUP BY owner, type")
def ag08b(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "caches").groupBy("owner", "type").agg(F.count("*").alias("n"))


@register("ag09_completion", "SELECT adventure_id, min(name) AS name, count(*) FILTER (id % 4 = 2) AS included, count(*) FILTER (id % 8 = 4) AS dropped, count(*) AS total, count(*) - count(*) FILTER (id % 4 = 2) AS missing FROM caches WHERE adventure_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (id % 4 = 2 OR id % 8 = 4) > 0")
def ag09(spark: SparkSession, sf: str) -> DataFrame:
    s = entity(spark, sf, "caches").filter("adventure_id IS NOT NULL").select("id", "adventure_id", C("name").alias("adventure_name"), F.lit(None).cast("int").alias("stage_total"))
    return A.adventure_completion(s, s.filter(C("id") % 4 == 2), s.filter(C("id") % 8 == 4))


@register("ag10_largest_owner", "SELECT owner, count(*) AS n FROM caches GROUP BY owner ORDER BY n DESC, owner LIMIT 1")
def ag10(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "caches").groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(1)


@register("ag11_saved_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'")
def ag11(spark: SparkSession, sf: str) -> DataFrame:
    tours = load(spark, sf, "orders").filter(C("o_orderstatus") == "F").groupBy((C("o_orderkey") % 100).alias("tour")).agg(F.collect_list("o_custkey").alias("cache_ids"))
    return tours.select(F.explode("cache_ids").alias("id")).distinct()


@register("ag12_kinds", "SELECT c.id, string_agg(DISTINCT l.kind, ',' ORDER BY l.kind) AS kinds FROM caches c JOIN landuse l ON c.lng > l.west AND c.lng < l.east AND c.lat > l.south AND c.lat < l.north GROUP BY c.id")
def ag12(spark: SparkSession, sf: str) -> DataFrame:
    from trailspark.operators.spatial import landuse_of_points
    from trailspark.plans.bindings import polygons, shared_checkpoint

    found = landuse_of_points(entity(spark, sf, "caches").select("id", "lng", "lat"), polygons(spark, sf, spread=True), keep=shared_checkpoint)
    return found.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@register("ag13_graph_stats", f"""
    WITH e AS ({SQL_LEGS} AND from_id < to_id), m AS (SELECT meters, row_number() OVER (ORDER BY meters) AS r, count(*) OVER () AS n FROM e)
    SELECT (SELECT count(*) FROM caches) AS nodes, count(*) AS edges, count(*) FILTER (meters <= 5 AND straight >= 50) AS suspicious, {sql_cents('max(meters)')} AS longest, {sql_cents('avg(CASE WHEN straight > 0 THEN meters / straight END)')} AS detour,
           (SELECT count(*) FROM caches WHERE id NOT IN (SELECT from_id FROM e UNION SELECT to_id FROM e)) AS isolated, (SELECT {sql_cents('max(meters)')} FROM m WHERE r = n // 2 + 1) AS median FROM e""")
def ag13(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    stats = A.graph_stats(caches.select("id"), make_legs(caches).filter("from_id < to_id").persist())
    return stats.select("nodes", "edges", "suspicious", cents(C("longest")).alias("longest"), cents(C("detour")).alias("detour"), "isolated", cents(C("median")).alias("median"))


@register("ag14_nearest_walkable", f"SELECT from_id AS id, {sql_cents('min(meters)')} AS nearest_m FROM ({SQL_LEGS}) GROUP BY 1")
def ag14(spark: SparkSession, sf: str) -> DataFrame:
    legs = make_legs(entity(spark, sf, "caches"))
    both = legs.unionByName(legs)
    return A.nearest_walkable(both.select("from_id", "to_id", "meters").filter("from_id < to_id").unionByName(legs.select("from_id", "to_id", "meters").filter("from_id > to_id").select(C("from_id"), C("to_id"), "meters"))).join(legs.groupBy(C("from_id").alias("id")).agg(F.min("meters").alias("own")), "id").select("id", cents(C("own")).alias("nearest_m"))


@register("ag15_degree", f"SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM ({SQL_LEGS} AND from_id < to_id) UNION ALL SELECT to_id FROM ({SQL_LEGS} AND from_id < to_id)) GROUP BY id")
def ag15(spark: SparkSession, sf: str) -> DataFrame:
    return A.degree(make_legs(entity(spark, sf, "caches")).filter("from_id < to_id").select("from_id", "to_id", "meters"))


_BOTH = f"(SELECT from_id AS id, to_id AS other, meters FROM ({SQL_LEGS} AND from_id < to_id) UNION ALL SELECT to_id, from_id, meters FROM ({SQL_LEGS} AND from_id < to_id))"


@register("ag16_core_distance", f"SELECT c.id, coalesce((SELECT {sql_cents('meters')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY meters, other) AS r FROM {_BOTH}) e WHERE e.id = c.id AND r = 3), -1) AS core FROM caches c")
def ag16(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    core = A.core_distance(caches, make_legs(caches).filter("from_id < to_id"), 3)
    return core.select("id", F.when(C("core") == float("inf"), -1.0).otherwise(cents(C("core"))).alias("core"))


@register("ag17_moments", f"SELECT owner, {sql_cents('avg(difficulty)')} AS mean, {sql_cents('stddev_pop(difficulty)')} AS sd, {sql_cents('median(difficulty)')} AS median, {sql_cents('CAST(count(*) FILTER (difficulty >= 3) AS DOUBLE) / count(*)')} AS share FROM caches GROUP BY owner")
def ag17(spark: SparkSession, sf: str) -> DataFrame:
    d = C("difficulty")
    return entity(spark, sf, "caches").groupBy("owner").agg(cents(F.avg(d)).alias("mean"), cents(F.stddev_pop(d)).alias("sd"), cents(F.median(d)).alias("median"), cents(F.count_if(d >= 3) / F.count("*")).alias("share"))


@register("ag18_bounds", f"SELECT owner, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north, {sql_cents('avg(lng)')} AS lng, {sql_cents('avg(lat)')} AS lat, count(*) AS n FROM caches GROUP BY owner")
def ag18(spark: SparkSession, sf: str) -> DataFrame:
    b = A.bounds(entity(spark, sf, "caches"), "owner")
    return b.withColumns({"lng": cents(C("lng")), "lat": cents(C("lat"))})


@register("ag19_median_distance", f"WITH d AS (SELECT a.owner, {metres('a', 'b')} AS m FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY m) AS r, count(*) OVER (PARTITION BY owner) AS n FROM d) SELECT owner, {sql_cents('m')} AS median FROM r WHERE r = n // 2 + 1")
def ag19(spark: SparkSession, sf: str) -> DataFrame:
    p = entity(spark, sf, "caches").select("owner", "id", "lng", "lat")
    q = p.select("owner", C("id").alias("o"), C("lng").alias("x"), C("lat").alias("y"))
    d = p.join(q, "owner").filter("id <> o").select("owner", haversine(C("lng"), C("lat"), C("x"), C("y")).alias("m"))
    return d.groupBy("owner").agg(cents(A.upper_median(C("m"))).alias("median"))


@register("ag20_cover_circle", f"""
    WITH b AS (SELECT owner, (min(lng) + max(lng)) / 2 AS lng, (min(lat) + max(lat)) / 2 AS lat FROM caches GROUP BY owner)
    SELECT b.owner, {sql_cents("least(50000e0, greatest(500e0, max(" + metres('b', 'c') + ") * 1.12e0))")} AS radius FROM b JOIN caches c ON c.owner = b.owner GROUP BY b.owner""")
def ag20(spark: SparkSession, sf: str) -> DataFrame:
    c = entity(spark, sf, "caches")
    b = A.bounds(c, "owner").select("owner", ((C("west") + C("east")) / 2).alias("x"), ((C("south") + C("north")) / 2).alias("y"))
    far = c.join(b, "owner").groupBy("owner").agg(F.max(haversine(C("x"), C("y"), C("lng"), C("lat"))).alias("far"))
    return far.select("owner", cents(F.least(lit(50_000), F.greatest(lit(500), C("far") * lit(1.12)))).alias("radius"))


@register("ag21_backfill_groups", f"""
    WITH m AS (SELECT owner, adventure_id, avg(lng) AS lng, avg(lat) AS lat, count(*) AS n FROM caches WHERE adventure_id IS NOT NULL GROUP BY 1, 2)
    SELECT m.owner, m.adventure_id AS title, m.n, greatest(800, ceil(max({metres('m', 'c')})) + 600) AS radius_m FROM m JOIN caches c ON c.owner = m.owner AND c.adventure_id = m.adventure_id GROUP BY 1, 2, 3""")
def ag21(spark: SparkSession, sf: str) -> DataFrame:
    s = entity(spark, sf, "caches").filter("adventure_id IS NOT NULL").withColumnRenamed("adventure_id", "title")
    return A.backfill_groups(s).select("owner", "title", "n", "radius_m")


@register("ag22_retrace", """
    WITH c AS (SELECT owner, id, floor(CAST(id % 7 AS DOUBLE) / 2 + 0.5) AS x, floor(CAST(id % 5 AS DOUBLE) / 2 + 0.5) AS y FROM caches),
    s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY owner ORDER BY id)), v AS (SELECT owner, x, y, count(*) AS n FROM s WHERE px IS DISTINCT FROM x OR py IS DISTINCT FROM y GROUP BY 1, 2, 3)
    SELECT owner AS tour_id, CAST(sum(greatest(n - 1, 0)) AS DOUBLE) * 2 AS retrace_m FROM v GROUP BY owner""")
def ag22(spark: SparkSession, sf: str) -> DataFrame:
    path = entity(spark, sf, "caches").select(C("owner").alias("tour_id"), C("id").alias("seq"), (C("id") % 7).cast("double").alias("x"), (C("id") % 5).cast("double").alias("y"))
    return A.retrace(path, 2.0)


@register("ag24_by_owner", "SELECT owner, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM caches WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0) GROUP BY owner")
def ag24(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf, "orders").filter(C("o_orderkey") % 7 == 0).select(C("o_custkey").alias("id"))
    own = entity(spark, sf, "caches").join(ids, "id", "left_semi")
    return own.groupBy("owner").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@register("ag25_pass_timing", f"""
    WITH t AS (SELECT event_type AS phase, event_id % 2 = 0 AS cold, value FROM events WHERE value IS NOT NULL)
    SELECT phase, {sql_cents('avg(value)')} AS mean, {sql_cents('stddev_pop(value)')} AS sd, {sql_cents('avg(value) FILTER (cold) - avg(value) FILTER (NOT cold)')} AS delta, {sql_cents('sum(value) / (SELECT sum(value) FROM t) * 100')} AS share FROM t GROUP BY phase""")
def ag25(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "events").filter("value IS NOT NULL").select(C("event_type").alias("phase"), (C("event_id") % 2 == 0).alias("cold"), "value")
    by = t.groupBy("phase").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), (F.avg(F.when(C("cold"), C("value"))) - F.avg(F.when(~C("cold"), C("value")))).alias("delta"), F.sum("value").alias("total"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return by.select("phase", cents(C("mean")).alias("mean"), cents(C("sd")).alias("sd"), cents(C("delta")).alias("delta"), cents(C("total") / whole * 100).alias("share"))


# ---- windows, order, sets --------------------------------------------------------------------------------------------


@register("wn01_dedupe_stages", """
    WITH s AS (SELECT l_suppkey % 25 AS owner, concat('adv', l_partkey % 40) AS adventure_id, l_linenumber AS stage_sequence, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 2 = 0 THEN concat('LC', l_orderkey, '-', l_linenumber) ELSE concat('LC', l_orderkey) END AS code FROM lineitem)
    SELECT owner, adventure_id, stage_sequence, id FROM (SELECT *, row_number() OVER (PARTITION BY owner, adventure_id, stage_sequence ORDER BY regexp_matches(code, '-[0-9]+$'), id) AS n FROM s) WHERE n = 1""")
def wn01(spark: SparkSession, sf: str) -> DataFrame:
    l = load(spark, sf, "lineitem")
    code = F.concat(F.lit("LC"), C("l_orderkey").cast("string"), F.when(C("l_orderkey") % 2 == 0, F.concat(F.lit("-"), C("l_linenumber").cast("string"))).otherwise(F.lit("")))
    s = l.select((C("l_suppkey") % 25).alias("owner"), F.concat(F.lit("adv"), (C("l_partkey") % 40).cast("string")).alias("adventure_id"), C("l_linenumber").alias("stage_sequence"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), code.alias("code"))
    return A.dedupe_stages(s).select("owner", "adventure_id", "stage_sequence", "id")


@register("tk01_page", f"SELECT id, (SELECT count(*) FROM ({_VIEW}) WHERE state = 'missing' AND kind = 'walking') AS total FROM ({_VIEW}) WHERE state = 'missing' AND kind = 'walking' ORDER BY id LIMIT 20 OFFSET 0")
def tk01(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.state_view(entity(spark, sf, "caches"), entity(spark, sf, "states")).filter((C("state") == "missing") & (C("kind") == "walking"))
    return rows.orderBy("id").offset(0).limit(20).select("id").crossJoin(rows.agg(F.count("*").alias("total")))  # one row


@register("tk02_largest", "SELECT osm_id, kind FROM landuse ORDER BY floor((east - west) * (north - south) * 1e8 + 0.5) DESC, osm_id LIMIT 100")
def tk02(spark: SparkSession, sf: str) -> DataFrame:
    size = F.floor((C("east") - C("west")) * (C("north") - C("south")) * 1e8 + 0.5)
    return entity(spark, sf, "landuse").orderBy(size.desc(), "osm_id").limit(100).select("osm_id", "kind")


@register("tk03_growth_pool", f"SELECT id, {sql_cents(metres('caches', 'c'))} AS distance_m, {metres('caches', 'c')} <= 4000 AS in_radius FROM caches, (SELECT 5.1e0 AS lng, 52.1e0 AS lat) c WHERE {metres('caches', 'c')} <= 9000 ORDER BY {metres('caches', 'c')}, id LIMIT 300")
def tk03(spark: SparkSession, sf: str) -> DataFrame:
    return A.growth_pool(entity(spark, sf, "caches"), (5.1, 52.1), 4000, 9000, 300).select("id", cents(C("distance_m")).alias("distance_m"), "in_radius")


@register("tk04_rank_candidates", "SELECT owner AS cluster, count(*) AS size, CAST(sum(id % 10) AS BIGINT) AS total FROM caches GROUP BY owner HAVING count(*) >= 2 ORDER BY total DESC, owner LIMIT 5")
def tk04(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rank(entity(spark, sf, "caches").groupBy(C("owner").alias("cluster")).agg(F.count("*").alias("size"), F.sum(C("id") % 10).alias("total")))


@register("tk05_walk_candidates", f"SELECT id, id % 4 AS prize FROM caches, (SELECT 5.1e0 AS lng, 52.1e0 AS lat) c WHERE 2 * {metres('caches', 'c')} <= 9000 ORDER BY id % 4 DESC, {metres('caches', 'c')}, id LIMIT 60")
def tk05(spark: SparkSession, sf: str) -> DataFrame:
    at = (5.1, 52.1)
    return tours.walk_candidates(entity(spark, sf, "caches"), C("id") % 4, at, at, 9000).select("id", "prize")


@register("tk06_parking_options", f"SELECT p.id, {sql_cents(metres('p', 'c') + ' * 1.3e0')} AS walk_m FROM parking p, caches c WHERE c.id = 7 AND {metres('p', 'c')} <= 30000 ORDER BY {metres('p', 'c')} < 1, {metres('p', 'c')}, p.id LIMIT 8")
def tk06(spark: SparkSession, sf: str) -> DataFrame:
    """Around one cache."""
    one = entity(spark, sf, "caches").filter("id = 7")
    return tours.parking_options(entity(spark, sf, "parking"), one, 1.3, 30_000).select("id", cents(C("walk_m")).alias("walk_m"))


@register("tk07_newest", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 25 = 3 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def tk07(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").filter(C("o_custkey") % 25 == 3).orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50).select(C("o_orderkey").alias("id"))


@register("tk07b_profiles", "SELECT id, row_number() OVER (ORDER BY owner IS NOT NULL, lower(name), id) AS place FROM (SELECT id, CASE WHEN id % 3 > 0 THEN owner END AS owner, name FROM caches)")
def tk07b(spark: SparkSession, sf: str) -> DataFrame:
    """System profiles first, as the reference's route profiles have them."""
    rows = entity(spark, sf, "caches").select("id", F.when(C("id") % 3 > 0, C("owner")).alias("owner"), "name")
    return rows.select("id", F.row_number().over(Window.orderBy(C("owner").isNotNull(), F.lower("name"), "id")).cast("long").alias("place"))


@register("tk08_seeds", """
    WITH t AS (SELECT min(id) AS id FROM caches GROUP BY floor(lng * 111320e0 * cos(radians(lat)) / 2500), floor(lat * 111320e0 / 2500)), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM t)
    SELECT id FROM n WHERE r % greatest(1, CAST(ceil(n / 12e0) AS BIGINT)) = 0""")
def tk08(spark: SparkSession, sf: str) -> DataFrame:
    return A.thin_seeds(entity(spark, sf, "caches").select("id", "lng", "lat"), 2500, 12).select("id")


@register("so01_kinds", "SELECT 'walking' AS kind UNION ALL SELECT 'landuse'")
def so01(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT 'walking' AS kind UNION ALL SELECT 'landuse'")


@register("so02_union", "SELECT id FROM caches WHERE id % 3 = 0 UNION SELECT id FROM caches WHERE id % 5 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0")
def so02(spark: SparkSession, sf: str) -> DataFrame:
    ids = entity(spark, sf, "caches").select("id")
    return ids.filter(C("id") % 3 == 0).union(ids.filter(C("id") % 5 == 0)).union(load(spark, sf, "orders").filter(C("o_orderkey") % 50 == 0).select("o_custkey")).distinct()


@register("so03_missing_pairs", f"SELECT a.id AS from_id, b.id AS to_id FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id WHERE a.owner = 3 EXCEPT SELECT from_id, to_id FROM ({SQL_LEGS}) WHERE osrm_version = 'v1'")
def so03(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    return A.missing_pairs(A.ordered_pairs(caches.filter(C("owner") == 3), "owner"), make_legs(caches), "v1")


@register("so04_ordered_pairs", "SELECT a.id AS from_id, b.id AS to_id FROM caches a JOIN caches b ON a.adventure_id = b.adventure_id AND a.id <> b.id")
def so04(spark: SparkSession, sf: str) -> DataFrame:
    return A.ordered_pairs(entity(spark, sf, "caches").filter("adventure_id IS NOT NULL"), "adventure_id")
