"""What the review of round 2 found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.operators import spatial as S


def boxes(spark, rows):
    """(osm_id, kind, west, south, east, north) as polygons."""
    from trailspark.plans.bindings import rings_of_box

    return spark.createDataFrame(rows, "osm_id long, kind string, west double, south double, east double, north double").withColumn("rings", rings_of_box())


@pytest.fixture(scope="module")
def stacked(spark):
    """Points, and boxes of one kind that lie over each other: 300 000 pairs."""
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 0.01, (300, 2)) + (5.0, 52.0)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, lng double, lat double")
    corners = rng.uniform(-0.004, 0.01, (2000, 2)) + (5.0, 52.0)
    rows = [(i, "forest" if i % 50 else "park", float(x), float(y), float(x) + 0.001 * (1 + i % 9), float(y) + 0.001 * (1 + i % 7)) for i, (x, y) in enumerate(corners)]
    return at, points, rows


def test_kinds_of_stacked_polygons(spark, stacked):
    at, points, rows = stacked
    got = {(r["id"], r["kind"]) for r in S.landuse_of_points(points, boxes(spark, rows)).collect()}
    assert got == {(i, k) for _, k, w, s, e, n in rows for i, (x, y) in enumerate(at) if w < x < e and s < y < n}


def test_stacked_polygons_leave_few_to_be_tested(spark, stacked):
    """what grows with points times polygons isn't tested ring by ring."""
    _, points, rows = stacked
    cells = S._kinds_of_cells(boxes(spark, rows).filter("kind = 'forest'"), 0.002)
    assert cells.filter("whole AND keys IS NOT NULL").count() == 0
    left = cells.filter("NOT whole").select(F.explode("keys")).count()
    assert left < 0.25 * len(rows) * 20


def test_areas_of_one_size_are_equal(spark):
    """boxes of one size far from the origin; the reckoning of SQL is exact to the last bit."""
    rows = [(i, "park", 5 + i / 5e4, 52 + i * 7 % 997 / 5e4) for i in range(500)]
    df = boxes(spark, [(*r, r[2] + 3e-3, r[3] + 5e-3) for r in rows])
    got = df.select(((F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))).alias("want"), S.area(F.col("rings")).alias("got")).toPandas()
    assert (got["want"] == got["got"]).all()


def crowd(n=3000, seed=2):
    """Places in metres, most of them in one crowd, some far apart."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 300, (n - n // 20, 2)), rng.uniform(-4000, 4000, (n // 20, 2))])


def test_nearest_of_a_crowd(spark):
    """Small radii first give the same neighbours as all pairs, for crowds, lonely points and points without any neighbour."""
    xy = crowd(600)
    lng, lat = 5 + xy[:, 0] / 68_000, 52 + xy[:, 1] / 111_000
    points = spark.createDataFrame([(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(zip(lng, lat, strict=True))], "id long, owner long, lng double, lat double")
    assert len(S._radii(points, 5, 3000)) > 1
    got = {(r["from_id"], r["to_id"], r["rank"]) for r in S.nearest_neighbours(points, points, 5, 3000).collect()}
    x, y = np.radians(lng), np.radians(lat)
    h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    d = 2 * 6_371_008.8 * np.arcsin(np.sqrt(h))
    want = set()
    for i in range(600):
        near = sorted((d[i, j], j) for j in range(600) if j != i and j % 2 == i % 2 and d[i, j] <= 3000)[:5]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    assert got == want


def test_router_is_asked_for_candidates_only(spark):
    """The walking graph needs no table of all legs."""
    from trailspark.operators import graph as G
    from trailspark.plans.q_spatial import legs_of, make_legs

    xy = crowd(400)
    points = spark.createDataFrame([(i, 0, float(5 + x / 68_000), float(52 + y / 111_000)) for i, (x, y) in enumerate(xy)], "id long, owner long, lng double, lat double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.walking_graph(points, legs_of, 4, 4000, 3000)) == rows(G.walking_graph(points, make_legs(points), 4, 4000, 3000))


def test_legs_of_other_caches_are_not_made(spark):
    """stages' legs come from stages alone."""
    from trailspark.operators.aggregates import incomplete_pairs
    from trailspark.plans.bindings import entity
    from trailspark.plans.q_spatial import make_legs

    caches = entity(spark, "/root/testdata/sf0.01", "caches")
    stages = caches.filter("adventure_id IS NOT NULL")
    assert sorted(incomplete_pairs(stages, make_legs(stages)).collect()) == sorted(incomplete_pairs(stages, make_legs(caches)).collect())


def test_kernels_of_large_groups():
    """What took time by the square of a group's size."""
    import time

    from trailspark.operators import cluster as K

    xy = crowd(12_000)
    ids, place, began = list(range(len(xy))), dict(enumerate(map(tuple, xy.tolist()))), time.process_time()
    by_x = np.argsort(xy[:, 0]).tolist()
    far = lambda a, b: float(np.hypot(*(xy[a] - xy[b])))
    edges = [(a, b, far(a, b)) for s in (1, 2, 3) for a, b in zip(by_x, by_x[s:])]  # noqa: B905
    for strategy in ("hdbscan-star", "hdbscan", "dbscan"):
        assert K.cluster(ids, edges, strategy, 500, 4)
    assert sum(map(len, K.dbscan_planar(ids, place, 150, 3))) > 10_000
    assert K.tree_length_planar(xy) > 0
    assert time.process_time() - began < 60


def test_planar_kernels_equal_those_of_all_pairs():
    from trailspark.operators import cluster as K

    xy = np.round(crowd(300), -1)  # many equal distances
    ids, place = list(range(300)), dict(enumerate(map(tuple, xy.tolist())))
    far = lambda a, b: float(np.hypot(*(xy[a] - xy[b])))
    for eps, least in ((60, 3), (100, 4), (400, 3)):
        assert K.dbscan_planar(ids, place, eps, least) == K.dbscan(ids, far, eps, least)
    assert K.tree_length_planar(xy) == pytest.approx(K.tree_length(300, far))


def test_nearest_parking_of_each_cluster(spark):
    """short links first; clusters with a parking at hand, far off, and out of reach."""
    from trailspark.plans import tours as T

    rng = np.random.default_rng(5)
    at = lambda n: [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 0.02, (n, 2)) + (5, 52))]
    members = [(i % 20, i, x, y) for i, x, y in at(200)] + [(20, 500, 5.05, 52.0), (21, 501, 9.0, 50.0)]
    parking = at(150) + [(900, 5.05 + 300 / 68_000, 52.0), (901, 5.05 + 300 / 68_000, 52.0)]
    df = spark.createDataFrame(members, "cluster long, id long, lng double, lat double")
    picked = T.pick_parking(df, spark.createDataFrame(parking, "id long, lng double, lat double"), 400.0)
    got = {r["cluster"]: r["parking_id"] for r in picked.collect()}
    want = {}
    for c, _, x, y in members:
        for p, u, v in parking:
            h = np.sin(np.radians(v - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(v)) * np.sin(np.radians(u - x) / 2) ** 2
            d = 2 * 6_371_008.8 * np.arcsin(np.sqrt(h))
            if d <= 400 and (d, p) < want.get(c, (1e9, 0)):
                want[c] = d, p
    assert got == {c: p for c, (_, p) in want.items()} and got[20] == 900 and 21 not in got


def test_shared_ways_join_legs_and_not_cells(spark):
    """repeated points and legs in several rows count once; no row a cell."""
    from trailspark.plans import tours as T

    way = lambda *xs: [(float(x), 0.0) for x in xs]
    rows = [(1, 10, way(0, 50, 100, 100)), (1, 10, way(100, 150)), (2, 20, way(150, 100, 50, 900)), (3, 30, way(900, 1000)), (4, 40, None)]
    legs = spark.createDataFrame(rows, "seq long, to_stop long, points array<struct<x:double,y:double>>")
    assert [r["stop"] for r in T.fringe(legs, 50.0, 140.0).collect()] == [10]
    assert T.fringe(legs, 50.0, 150.0).count() == 0
    assert "explode" not in T.fringe(legs, 50.0)._jdf.queryExecution().toString()


def test_discovery_plan_does_not_hold_its_pool(spark, sf):
    """the driver's memory went into a plan that held all that makes the pool, and once more at each mention."""
    from trailspark.plans import driver_queries

    df = driver_queries.queries()["gr24_discovery"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") < 30


def test_discovery_is_the_same_by_either_way_of_keeping(spark):
    """a persisted pool gives what a checkpointed one does."""
    from trailspark.plans import q_graph as Q

    sf = "/root/testdata/sf0.01"
    caches, details, rows = Q.entity(spark, sf, "caches"), Q._details(spark, sf), lambda df: sorted(map(str, df.select("cluster", "size", F.round("total", 6), "cache_ids").collect()))
    want = rows(Q.D.discover(caches, Q.legs_of, *details, Q._request()))
    assert want and rows(Q.D.discover(caches, Q.legs_of, *details, Q._request(), keep=Q.shared_checkpoint)) == want


def test_explain_asks_for_the_graph_of_its_owner(spark, sf):
    """one owner's graph is made, and is the part of all owners' graph that is theirs."""
    from trailspark.plans import driver_queries
    from trailspark.plans import q_graph as Q

    df = driver_queries.queries()["gr25_explain"](spark, sf)
    scans = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "c_nationkey" in x]
    assert scans and all(" = 3)" in x for x in scans)
    caches, edges = Q.graph(spark, sf)
    want = Q.D.explain(caches.filter("owner = 3"), edges, list(range(3, 1500, 75)), Q._request())
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


def test_split_makes_its_tree_once():
    """a cut made the tree of each side anew, over all of its pairs; parts, ties and unreachable pairs stay as they were."""
    from trailspark.operators import cluster as K

    def split(members, distance, budget, least, depth=64):
        if len(members) < least:
            return []
        edges = [(a, b, distance(a, b)) for i, a in enumerate(members) for b in members[i + 1 :]]
        tree = K.spanning_forest(members, [e for e in edges if np.isfinite(e[2])])
        if 2 * sum(w for _, _, w in tree) <= budget or depth == 0 or not tree:
            return [sorted(members)]
        longest = max(tree, key=lambda e: (e[2], -e[0], -e[1]))
        return [c for side in K.component_clusters(members, [e for e in tree if e != longest], 1) for c in split(side, distance, budget, least, depth - 1)]

    for seed in range(12):
        xy = np.round(crowd(60, seed), -2 if seed % 2 else 0)
        far = lambda a, b, xy=xy: float(np.hypot(*(xy[a] - xy[b]))) if abs(xy[a][0] - xy[b][0]) < 2500 else np.inf
        members = np.random.default_rng(seed).permutation(60).tolist()
        for budget, depth in ((500, 64), (3000, 64), (20_000, 64), (500, 3)):
            assert K.split_by_tree(members, far, budget, 3, depth) == split(members, far, budget, 3, depth)
    calls, line = [], lambda a, b: calls.append(1) or float(abs(a - b) + (a + b) / 1000)
    K.split_by_tree(list(range(50)), line, 20.0, 3)
    assert len(calls) <= 50 * 49 // 2


def test_matrix_is_filled_where_its_pairs_are_made(spark, sf):
    """all pairs, their legs and their ways were shuffled against each other; now only points are, and pairs, hits and metres stay the same."""
    from trailspark.plans import driver_queries
    from trailspark.plans import tours as T
    from trailspark.plans.q_spatial import legs_beside, make_legs

    xy = crowd(150)
    points = spark.createDataFrame([(i, i % 2, float(5 + x / 68_000), float(52 + y / 111_000)) for i, (x, y) in enumerate(xy)], "id long, owner long, lng double, lat double")
    met = S.all_pairs(points, 20)
    got = sorted((r["owner"], r["l_id"], r["r_id"]) for r in met.collect())
    assert got == sorted((a % 2, a, b) for a in range(150) for b in range(150) if a != b and a % 2 == b % 2)
    assert met.rdd.getNumPartitions() == 16
    pairs = met.select(F.col("l_id").alias("from_id"), F.col("r_id").alias("to_id"), S.haversine(F.col("l_lng"), F.col("l_lat"), F.col("r_lng"), F.col("r_lat")).alias("meters"))
    routed = {"meters": F.col("meters") * 1.5, "seconds": F.col("meters") * 1.5 / 1.4}
    tables = T.fill_matrix(pairs, make_legs(points), pairs.select("from_id", "to_id", *[c.alias(n) for n, c in routed.items()]), "v1").select("from_id", "to_id", "meters", "seconds", "hit")
    filled = T.fill_matrix(pairs, legs_beside(), routed, "v1").select("from_id", "to_id", "meters", "seconds", "hit")
    assert sorted(map(tuple, filled.collect())) == sorted(map(tuple, tables.collect()))
    assert {r["hit"] for r in filled.collect()} == {True, False}
    plan = driver_queries.queries()["pl01_fill_matrix"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_pairs_within_are_those_of_the_distance(spark):
    """Chords find the pairs that the distance does, also at the radius itself."""
    xy = crowd(200)
    points = spark.createDataFrame([(i, i % 2, float(5 + x / 68_000), float(52 + y / 111_000)) for i, (x, y) in enumerate(xy)], "id long, owner long, lng double, lat double")
    points = points.unionByName(spark.createDataFrame([(900, 0, None, 52.0), (901, 0, 5.0, 52.0), (902, 0, 5.0, 52.0)], points.schema))
    some = S.range_join(points, points, 5000.0, (F.col("l_owner") == F.col("r_owner")) & (F.col("l_id") != F.col("r_id"))).toPandas()
    for radius in (1.0, 700.0, 4000.0, *some["meters"].quantile([0.1, 0.5], interpolation="nearest").tolist()):
        want = {(a, b, m) for a, b, m in zip(some["l_id"], some["r_id"], some["meters"], strict=True) if m <= radius}
        assert {(r["from_id"], r["to_id"], r["meters"]) for r in S.pairs_within(points, radius).collect()} == want


def test_legs_are_rewritten_where_they_are_made(spark, sf):
    """Legs were shuffled against those that came in, which lie beside them; the new snapshot stays the same."""
    from trailspark.operators import maintenance as M
    from trailspark.plans import driver_queries
    from trailspark.plans.q_spatial import all_legs, make_legs

    xy = crowd(120)
    points = spark.createDataFrame([(i, i % 2, float(5 + x / 68_000), float(52 + y / 111_000)) for i, (x, y) in enumerate(xy)], "id long, owner long, lng double, lat double")
    legs = make_legs(points).drop("straight")
    old = F.when(F.col("from_id") % 5 > 0, F.col("osrm_version"))  # some have none
    legs, beside = legs.withColumn("osrm_version", old), all_legs(points).withColumn("osrm_version", old)
    assert sorted(map(str, legs.collect())) == sorted(map(str, beside.select(*legs.columns).collect()))
    came = (F.col("from_id") + F.col("to_id")) % 4 == 0
    changes = {"meters": F.col("meters") * 2, "seconds": (F.col("from_id") % 9 * 100).cast("double"), "source": F.when(F.col("to_id") % 3 == 0, "noroute").otherwise("route"), "osrm_version": F.lit("v1")}
    tabled = legs.filter(came).withColumns(changes)
    columns = {c: F.when(came, x) for c, x in changes.items()}
    for f in (M.upsert_route_legs, lambda a, b: M.upsert_matrix_cells(a, b, "v1")):
        got, want = f(beside, columns).select(*legs.columns), f(legs, tabled).select(*legs.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != sorted(map(str, legs.collect()))
    for name in ("dm06_route_legs", "dm07_matrix_cells"):
        assert driver_queries.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
