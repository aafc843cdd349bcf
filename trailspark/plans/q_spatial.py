"""Queries of joins (JN) and geometry (GE); oracles compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import geo as G
from trailspark.operators import aggregates as A
from trailspark.operators import maintenance as M
from trailspark.operators import spatial as S
from trailspark.plans.bindings import cents, entity, load, metres, polygons, register, scalar, shared_checkpoint, sql_cents

C = F.col
_IN = "c.lng > l.west AND c.lng < l.east AND c.lat > l.south AND c.lat < l.north"
LEGS = f"""legs AS (SELECT a.id AS from_id, b.id AS to_id, {metres('a', 'b')} AS straight FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id)"""


def make_legs(points: DataFrame, radius_m: float = 4000) -> DataFrame:
    """Walked legs between all pairs of an owner within a radius: 1.3 times the straight line at 1.4 m/s, a few of them absent or absurd."""
    pairs = S.range_join(points.select("id", "owner", "lng", "lat"), points.select("id", "owner", "lng", "lat"), radius_m, (C("l_owner") == C("r_owner")) & (C("l_id") != C("r_id")))
    return legs_of(pairs.select(C("l_id").alias("from_id"), C("r_id").alias("to_id"), "meters"))


def leg_columns() -> dict[str, Column]:
    """What a leg holds besides its ends, over pairs (from_id, to_id, meters straight)."""
    key = C("from_id") * 31 + C("to_id")
    factor = F.when(key % 97 == 0, F.lit(0.0)).when(key % 89 == 0, F.lit(30.0)).otherwise(F.lit(1.3))
    walk = C("meters") * factor + F.when(key % 97 == 0, F.lit(2.0)).otherwise(F.lit(0.0))
    return {"profile": F.lit("foot"), "meters": walk, "seconds": walk / 1.4, "source": F.lit("table"), "osrm_version": F.when(key % 13 == 0, "v0").otherwise("v1")}


def legs_of(pairs: DataFrame) -> DataFrame:
    """The legs of pairs (from_id, to_id, meters straight)."""
    leg = F.struct("from_id", "to_id", *[c.alias(n) for n, c in leg_columns().items()], C("meters").alias("straight"))
    # a generated row holds what was computed: filters on a leg's columns would else be pushed below it and compute the distance at each mention
    return pairs.select(F.inline(F.array(leg)))


def legs_beside(radius_m: float = 4000) -> dict[str, Column]:
    """The legs of ``make_legs`` as columns over all pairs: null beyond the radius."""
    return {n: F.when(C("meters") <= radius_m, c) for n, c in leg_columns().items()}


def all_legs(points: DataFrame, radius_m: float = 4000) -> DataFrame:
    """The legs of ``make_legs`` for rewrites of them all: what nobody reads isn't reckoned (but for the straight line)."""
    return S.pairs_within(points, radius_m).select("from_id", "to_id", *[c.alias(n) for n, c in leg_columns().items()])


SQL_LEGS = f"""
    SELECT from_id, to_id, straight, CASE WHEN (from_id * 31 + to_id) % 97 = 0 THEN 2e0 WHEN (from_id * 31 + to_id) % 89 = 0 THEN straight * 30 ELSE straight * 1.3e0 END AS meters,
           CASE WHEN (from_id * 31 + to_id) % 13 = 0 THEN 'v0' ELSE 'v1' END AS osrm_version FROM (SELECT a.id AS from_id, b.id AS to_id, {metres('a', 'b')} AS straight FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id) WHERE straight <= 4000"""


@register("jn01_nearest", f"""
    WITH d AS (SELECT a.id AS from_id, b.id AS to_id, {metres('a', 'b')} AS m FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY m, to_id) AS rank FROM d WHERE m <= 3000)
    SELECT from_id, to_id, {sql_cents('m')} AS meters, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def jn01(spark: SparkSession, sf: str) -> DataFrame:
    points = entity(spark, sf, "caches")
    return S.nearest_neighbours(points, points, 3, 3000).select("from_id", "to_id", cents(C("meters")).alias("meters"), "rank")


@register("jn02_affected", f"""
    SELECT DISTINCT b.id FROM caches a JOIN caches b ON a.owner = b.owner WHERE a.id % 20 = 0 AND b.id % 20 <> 0 AND {metres('a', 'b')} <= 2500""")
def jn02(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    return S.affected(caches, caches.filter(C("id") % 20 == 0).select("id"), 2500)


@register("jn03_point_in_polygon", f"SELECT DISTINCT c.id, l.kind FROM caches c JOIN landuse l ON {_IN}")
def jn03(spark: SparkSession, sf: str) -> DataFrame:
    return S.landuse_of_points(entity(spark, sf, "caches").select("id", "lng", "lat"), polygons(spark, sf, spread=True), keep=shared_checkpoint)


@register("jn04_suspicious_legs", f"SELECT from_id, to_id FROM ({SQL_LEGS}) WHERE meters <= 5 AND straight >= 50")
def jn04(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    return M.split_suspicious(make_legs(caches), caches)[1].select("from_id", "to_id")


@register("jn05_adventure_groups", "SELECT adventure_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM caches WHERE adventure_id IN (SELECT adventure_id FROM caches WHERE id % 9 = 1 AND adventure_id IS NOT NULL) GROUP BY 1")
def jn05(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches").filter("adventure_id IS NOT NULL")
    hit = caches.filter(C("id") % 9 == 1).select("adventure_id")
    return caches.join(hit, "adventure_id", "left_semi").groupBy("adventure_id").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


_VIEW = "SELECT c.id, c.owner, k.kind, coalesce(s.state, 'missing') AS state, s.osrm_version, s.fetched_at FROM caches c CROSS JOIN (SELECT 'walking' AS kind UNION ALL SELECT 'landuse') k LEFT JOIN states s ON s.cache_id = c.id AND s.kind = k.kind"


@register("jn06_state_view", f"SELECT id, owner, kind, state FROM ({_VIEW})")
def jn06(spark: SparkSession, sf: str) -> DataFrame:
    return A.state_view(entity(spark, sf, "caches"), entity(spark, sf, "states")).select("id", "owner", "kind", "state")


@register("jn07_adventure_states", f"SELECT v.id, v.state FROM ({_VIEW}) v JOIN caches c ON c.id = v.id WHERE c.type = 'Adventure Lab' AND v.owner < 10 AND v.kind = 'walking'")
def jn07(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    view = A.state_view(caches, entity(spark, sf, "states")).filter((C("owner") < 10) & (C("kind") == "walking"))
    return view.join(caches.filter(C("type") == "Adventure Lab").select("id"), "id", "left_semi").select("id", "state")


_PAIRS = "SELECT a.id AS from_id, b.id AS to_id FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id WHERE a.owner = 3"


def _pairs_of(caches: DataFrame) -> DataFrame:
    return A.ordered_pairs(caches.filter(C("owner") == 3), "owner")


@register("jn08_matrix_cells", f"SELECT from_id, to_id, {sql_cents('meters')} AS meters FROM ({_PAIRS}) JOIN ({SQL_LEGS}) USING (from_id, to_id) WHERE osrm_version = 'v1'")
def jn08(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    legs = make_legs(caches).filter(C("osrm_version") == "v1")
    return _pairs_of(caches).join(legs, ["from_id", "to_id"]).select("from_id", "to_id", cents(C("meters")).alias("meters"))


@register("jn16_routed_legs", f"SELECT from_id, to_id, {sql_cents('meters')} AS meters FROM ({_PAIRS}) JOIN ({SQL_LEGS}) USING (from_id, to_id) WHERE osrm_version = 'v1' AND (from_id + to_id) % 3 = 0")
def jn16(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    legs = make_legs(caches).filter(C("osrm_version") == "v1").withColumn("geom", F.when((C("from_id") + C("to_id")) % 3 == 0, F.array(F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")))))
    return _pairs_of(caches).join(legs.filter("geom IS NOT NULL"), ["from_id", "to_id"]).select("from_id", "to_id", cents(C("meters")).alias("meters"))


@register("jn09_parents", """
    SELECT w.id, coalesce(b.id, s.id) AS cache_id FROM (SELECT *, concat('GC', cache_id) AS parent_code FROM waypoints) w
    LEFT JOIN (SELECT id + 100000 AS id, code FROM caches WHERE id % 4 = 0) b ON b.code = w.parent_code LEFT JOIN (SELECT id, code FROM caches WHERE owner < 12) s ON s.code = w.parent_code WHERE coalesce(b.id, s.id) IS NOT NULL""")
def jn09(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    w = entity(spark, sf, "waypoints").withColumn("parent_code", F.concat(F.lit("GC"), C("cache_id").cast("string"))).drop("cache_id")
    return M.parents_of_waypoints(w, caches.filter(C("id") % 4 == 0).select((C("id") + 100000).alias("id"), "code"), caches.filter(C("owner") < 12)).select("id", "cache_id")


@register("jn10_backfill", """
    SELECT c.id, coalesce(a.adv, b.adv) AS adventure_id FROM caches c
    LEFT JOIN (SELECT code, concat('A', id) AS adv FROM caches WHERE id % 3 = 0) a ON a.code = c.code
    LEFT JOIN (SELECT floor(lng * 100000 + 0.5) AS x, floor(lat * 100000 + 0.5) AS y, min_by(concat('B', id), id) AS adv FROM caches WHERE id % 2 = 0 GROUP BY 1, 2) b ON floor(c.lng * 100000 + 0.5) = b.x AND floor(c.lat * 100000 + 0.5) = b.y""")
def jn10(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches").select("id", "code", "lng", "lat")
    by_code = caches.filter(C("id") % 3 == 0).select("code", F.concat(F.lit("A"), C("id").cast("string")).alias("adventure_id"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat"), C("id").alias("seq"))
    by_place = caches.filter(C("id") % 2 == 0).select(F.lit("-").alias("code"), F.concat(F.lit("B"), C("id").cast("string")).alias("adventure_id"), "lng", "lat", C("id").alias("seq"))
    return M.backfill_ids(caches.withColumn("adventure_id", F.lit(None).cast("string")), by_code.unionByName(by_place)).select("id", "adventure_id")


def _next_place(kinds: str, radius: int) -> str:
    return f"(SELECT p.name FROM places p WHERE p.place IN ({kinds}) AND {metres('c', 'p')} <= {radius} ORDER BY {metres('c', 'p')}, p.osm_id LIMIT 1)"


@register("jn11_place_label", f"""
    SELECT c.id, coalesce((SELECT l.name FROM landuse l WHERE l.kind IN ('forest', 'park') AND l.name IS NOT NULL AND {_IN} ORDER BY (l.east - l.west) * (l.north - l.south), l.osm_id LIMIT 1),
        {_next_place("'city', 'town'", 8000)}, {_next_place("'village', 'hamlet', 'suburb'", 4000)}) AS label FROM caches c""")
def jn11(spark: SparkSession, sf: str) -> DataFrame:
    return S.nearest_place(entity(spark, sf, "caches"), entity(spark, sf, "places"), polygons(spark, sf, spread=True), keep=shared_checkpoint)


@register("jn12_nearest_parking", f"SELECT c.id, p.id AS parking_id, {sql_cents(metres('c', 'p'))} AS meters FROM caches c JOIN parking p ON {metres('c', 'p')} <= 1500 AND p.access IS DISTINCT FROM 'private'")
def jn12(spark: SparkSession, sf: str) -> DataFrame:
    from trailspark.operators.finder import parking_matches

    p = entity(spark, sf, "parking").filter(parking_matches(C("access"), C("fee"), None))
    near = S.range_join(entity(spark, sf, "caches").select("id", "lng", "lat"), p.select("id", "lng", "lat"), 1500)
    return near.select(C("l_id").alias("id"), C("r_id").alias("parking_id"), cents(C("meters")).alias("meters"))


@register("jn13_road_snap")
def jn13(spark: SparkSession, sf: str) -> DataFrame:
    """Roads are two-point lines from supplier to supplier; tested against all pairs of segments in the tests."""
    p = entity(spark, sf, "parking")
    end = F.struct((C("lng") + 0.004).alias("lng"), (C("lat") + (C("id") % 5 - 2) * 0.001).alias("lat"))
    roads = p.select(C("id").alias("osm_id"), F.array(F.struct("lng", "lat"), end).alias("line"))
    return S.snap_to_roads(entity(spark, sf, "caches").filter(C("owner") == 3).select("lng", "lat"), roads, 400, 20)


@register("jn14_merge", "SELECT id, name FROM caches WHERE owner < 5 UNION ALL SELECT id, upper(name) AS name FROM caches WHERE id % 2 = 0 AND owner >= 5")
def jn14(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches").select("id", "owner", "name")
    halo = caches.filter(C("id") % 2 == 0).withColumn("name", F.upper("name"))
    return A.first_of_lists(caches.filter(C("owner") < 5), halo).select("id", "name")


# ---- geometry --------------------------------------------------------------------------------------------------------


@register("ge01_within", f"SELECT a.id AS a, b.id AS b FROM caches a JOIN parking b ON {metres('a', 'b')} <= 700")
def ge01(spark: SparkSession, sf: str) -> DataFrame:
    """Great-circle metres stand in for spheroid ones."""
    near = S.range_join(entity(spark, sf, "caches").select("id", "lng", "lat"), entity(spark, sf, "parking").select("id", "lng", "lat"), 700)
    return near.select(C("l_id").alias("a"), C("r_id").alias("b"))


@register("ge02_contains", f"SELECT c.id, l.osm_id FROM parking c JOIN landuse l ON {_IN}")
def ge02(spark: SparkSession, sf: str) -> DataFrame:
    return S.polygons_of_points(entity(spark, sf, "parking").select("id", "lng", "lat"), polygons(spark, sf).select("osm_id", "kind", "rings")).select("id", "osm_id")


_BOX = lambda: S.box(C("rings"))


def _shape(name: str, columns, sql: str) -> None:
    @register(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return polygons(spark, sf).select("osm_id", *[c.alias(n) for n, c in columns().items()])


_shape("ge03_overlap", lambda: {"hit": S.boxes_overlap(_BOX(), S.expand_box(F.struct(F.lit(5.1).alias("west"), F.lit(52.1).alias("south"), F.lit(5.1).alias("east"), F.lit(52.1).alias("north")), F.lit(0.02)))},
       "SELECT osm_id, west <= 5.1e0 + 0.02e0 AND east >= 5.1e0 - 0.02e0 AND south <= 52.1e0 + 0.02e0 AND north >= 52.1e0 - 0.02e0 AS hit FROM landuse")
_R6 = lambda c: F.floor(c * 1e6 + 0.5) / F.lit(1e6)
_shape("ge04_centroid", lambda: {"lng": _R6(S.centroid(C("rings")[0])["lng"]), "lat": _R6(S.centroid(C("rings")[0])["lat"])},
       "SELECT osm_id, floor((west + east) / 2 * 1e6 + 0.5) / 1e6 AS lng, floor((south + north) / 2 * 1e6 + 0.5) / 1e6 AS lat FROM landuse")
_shape("ge05_area", lambda: {"area": F.floor(S.area(C("rings")) * 1e8 + 0.5) / F.lit(1e8)}, "SELECT osm_id, floor((east - west) * (north - south) * 1e8 + 0.5) / 1e8 AS area FROM landuse")
_shape("ge08_boxes", lambda: {"west": _R6(S.expand_box(_BOX(), F.lit(0.5))["west"]), "north": _R6(S.expand_box(_BOX(), F.lit(0.5))["north"])},
       "SELECT osm_id, floor((west - 0.5e0) * 1e6 + 0.5) / 1e6 AS west, floor((north + 0.5e0) * 1e6 + 0.5) / 1e6 AS north FROM landuse")
_T = "least(1e0, greatest(0e0, ((5.1e0 - lng1) * (lng2 - lng1) + (52.1e0 - lat1) * (lat2 - lat1)) / (pow(lng2 - lng1, 2) + pow(lat2 - lat1, 2))))"
scalar("ge06_closest_point", "pairs", {
    "lng": (lambda: _R6(S.closest_on_segment(C("lng1"), C("lat1"), C("lng2"), C("lat2"), F.lit(5.1), F.lit(52.1))["lng"]), f"floor((lng1 + {_T} * (lng2 - lng1)) * 1e6 + 0.5) / 1e6"),
    "lat": (lambda: _R6(S.closest_on_segment(C("lng1"), C("lat1"), C("lng2"), C("lat2"), F.lit(5.1), F.lit(52.1))["lat"]), f"floor((lat1 + {_T} * (lat2 - lat1)) * 1e6 + 0.5) / 1e6"),
})


def _line(*points: tuple[str, str]):
    return F.array(*[F.struct(F.expr(x).alias("lng"), F.expr(y).alias("lat")) for x, y in points])


@register("ge07_simplify", "SELECT id, CASE WHEN id % 2 = 1 THEN 5 ELSE 2 END AS n, CASE WHEN id % 2 = 1 THEN floor((lat1 + 1e-3) * 1e6 + 0.5) / 1e6 ELSE floor(lat1 * 1e6 + 0.5) / 1e6 END AS top FROM pairs")
def ge07(spark: SparkSession, sf: str) -> DataFrame:
    """Level lines of 21 points, every second with a spike in the middle, whose foot and tip stay."""
    up = lambda i: F.when((i == 10) & (C("id") % 2 == 1), G.lit(1e-3)).otherwise(G.lit(0.0))
    line = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((C("lng1") + i * 1e-4).alias("lng"), (C("lat1") + up(i)).alias("lat")))
    rows = entity(spark, sf, "pairs").select("id", S.simplify(line, 5e-5).alias("line"))
    return rows.select("id", F.size("line").alias("n"), (F.floor(F.array_max(F.transform("line", lambda p: p["lat"])) * 1e6 + 0.5) / F.lit(1e6)).alias("top"))


@register("ge07b_simplify_rings", "SELECT osm_id, 5 AS n, floor((east - west) * (north - south) * 1e8 + 0.5) AS area FROM landuse")
def ge07b(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles with eight points on each side come back as their corners; the tolerance is a share of the box."""
    side = lambda x1, y1, x2, y2: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct((C(x1) + (C(x2) - C(x1)) * k / 8).alias("lng"), (C(y1) + (C(y2) - C(y1)) * k / 8).alias("lat")))
    first = F.array(F.struct(C("west").alias("lng"), C("south").alias("lat")))
    ring = F.concat(side("west", "south", "east", "south"), side("east", "south", "east", "north"), side("east", "north", "west", "north"), side("west", "north", "west", "south"), first)
    rows = entity(spark, sf, "landuse").select("osm_id", S.simplify_rings(F.array(ring), (C("east") - C("west")) / 1024).alias("rings"))
    return rows.select("osm_id", F.size(C("rings")[0]).alias("n"), F.floor(S.area(C("rings")) * 1e8 + 0.5).alias("area"))


@register("ge09_geojson", "SELECT id, 2 AS n, floor(lng1 * 1e5 + 0.5) AS x, floor(lat2 * 1e5 + 0.5) AS y FROM pairs")
def ge09(spark: SparkSession, sf: str) -> DataFrame:
    text = G.line_string_to_json(_line(("lng1", "lat1"), ("lng2", "lat2")))
    back = G.line_string_from_json(C("json"))
    rows = entity(spark, sf, "pairs").select("id", text.alias("json")).select("id", back.alias("line"))
    return rows.select("id", F.size("line").alias("n"), F.floor(C("line")[0]["lng"] * 1e5 + 0.5).cast("double").alias("x"), F.floor(C("line")[1]["lat"] * 1e5 + 0.5).cast("double").alias("y"))


scalar("ge10_cells", "caches", {"cx": (lambda: G.grid_cell(C("lng"), 0.01), "CAST(floor(lng / 0.01e0) AS BIGINT)"), "cy": (lambda: G.grid_cell(C("lat"), 0.01), "CAST(floor(lat / 0.01e0) AS BIGINT)")})
scalar("ge11_join_lines", "pairs", {
    "n": (lambda: F.size(S.join_lines(F.array(_line(("id % 2", "0"), ("1", "1")), _line(("1", "1"), ("id % 3", "2")), _line(("id % 3", "2"), ("id % 3", "2"))))), "3"),
})


@register("ge12_overlap_grid", """
    WITH g AS (SELECT DISTINCT floor((lng - 5.1e0) * 111320 * cos(radians(52.1e0)) / 500 + 0.5) AS x, floor((lat - 52.1e0) * 111320 / 500 + 0.5) AS y FROM caches WHERE owner = 3)
    SELECT owner, count(*) AS hits FROM caches c JOIN g ON floor((c.lng - 5.1e0) * 111320 * cos(radians(52.1e0)) / 500 + 0.5) = g.x AND floor((c.lat - 52.1e0) * 111320 / 500 + 0.5) = g.y GROUP BY owner""")
def ge12(spark: SparkSession, sf: str) -> DataFrame:
    x, y = G.equirectangular(C("lng"), C("lat"), 5.1, 52.1)
    rows = entity(spark, sf, "caches").select("owner", F.floor(x / 500 + 0.5).alias("x"), F.floor(y / 500 + 0.5).alias("y"))
    grid = rows.filter(C("owner") == 3).select("x", "y").distinct()
    return rows.join(grid, ["x", "y"], "left_semi").groupBy("owner").agg(F.count("*").alias("hits"))


@register("vector_nearest", """
    WITH d AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d
               FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY d, to_id) AS r FROM d)
    SELECT from_id, to_id, floor(sqrt(d) * 1e6 + 0.5) / 1e6 AS distance FROM r WHERE r <= 3""")
def vector_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The k-NN shape on vectors: the stated query set against the rows of its label."""
    from pyspark.sql import Window

    v = load(spark, sf, "embeddings")
    a = v.filter(C("vec_id") % 20 == 0).select(C("vec_id").alias("from_id"), "label", C("embedding").alias("p"))
    b = v.select(C("vec_id").alias("to_id"), "label", C("embedding").alias("q"))
    sq = F.aggregate(F.zip_with("p", "q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    d = a.join(b, "label").filter("from_id <> to_id").select("from_id", "to_id", sq.alias("d"))
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("from_id").orderBy("d", "to_id"))).filter("r <= 3")
    return r.select("from_id", "to_id", (F.floor(F.sqrt("d") * 1e6 + 0.5) / F.lit(1e6)).alias("distance"))
