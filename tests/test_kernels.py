"""Kernels against brute force, hand-made cases and invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.functions import geo, text
from trailspark.functions import planning as P
from trailspark.operators import cluster as C
from trailspark.operators import finder, maintenance, spatial
from trailspark.operators import optimise as O
from trailspark.plans import settings, tours
from trailspark.sources import gpx, sinks
from trailspark.streaming import limiter


def places(seed=0, n=8):
    xy = np.random.default_rng(seed).uniform(0, 1000, (n, 2))
    return np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))


def test_orienteering_is_near_the_optimum():
    total = best = 0.0
    for seed in range(25):
        r = np.random.default_rng(seed)
        d = places(seed, 7)
        ends = r.uniform(0, 700, 7).tolist()
        p = O.Problem(r.integers(1, 6, 7).astype(float).tolist(), [60.0] * 7, d, ends, ends, 0.0, 1800.0)
        order = O.solve_orienteering(p)
        assert O.valid(order, p) and order == O.solve_orienteering(p)
        total += O.path_score(order, p)
        best += max(O.path_score(list(q), p) for n in range(8) for q in itertools.permutations(range(7), n) if O.path_seconds(list(q), p) <= p.budget)
    assert 0.95 * best <= total <= best + 1e-9


def test_orienteering_keeps_adventures_whole():
    d = places(3, 6)
    p = O.Problem([1.0] * 6, [10.0] * 6, d, [100.0] * 6, [100.0] * 6, 0.0, 1500.0, ["t"] * 6, ["a", "a", None, None, "b", "b"], [2, 1, None, None, 1, 2], [True, True, False, False, False, False], True)
    order = O.solve_orienteering(p)
    assert O.valid(order, p)
    assert not O.valid([0], p) and not O.valid([0, 1], p) and O.repair([0], p) == []


def test_variety_discounts_each_types_best_first():
    p = O.Problem([1.0, 4.0, 2.0], [0.0] * 3, np.zeros((3, 3)), [0.0] * 3, [0.0] * 3, 0.0, 10.0, ["a", "a", "b"], variety_weight=2.0)
    for order in itertools.permutations(range(3)):
        assert O.path_score(list(order), p) == 4 + 1 / 2 + 2
    assert O.path_score([], p) == 0.0


def test_variety_prefers_another_type():
    xy = np.array([[0.0, 10], [0, 11], [0, -12]])
    d, ends = np.abs(xy[:, None, 1] - xy[None, :, 1]), np.abs(xy[:, 1]).tolist()
    for weight, want in ((0.0, {"Traditional"}), (4.0, {"Traditional", "Multi"})):
        p = O.Problem([1.0] * 3, [0.0] * 3, d, ends, ends, 0.0, 45.0, ["Traditional", "Traditional", "Multi"], variety_weight=weight)
        assert {p.types[i] for i in O.solve_orienteering(p)} == want


def test_adventures_in_one_piece():
    xy = np.array([10.0, 30, 20])
    d = np.abs(xy[:, None] - xy[None])
    p = O.Problem([1.0] * 3, [0.0] * 3, d, xy.tolist(), xy.tolist(), 0.0, 1000.0, ["t"] * 3, ["a", "a", None], [1, 2, None], [False] * 3, interleave=False)
    order = O.solve_orienteering(p)
    assert sorted(order) == [0, 1, 2] and abs(order.index(0) - order.index(1)) == 1
    assert not O.keeps_rules([0, 2, 1], p) and O.keeps_rules([2, 1, 0], p)


def test_units_against_all_orders():
    """Whole adventures, with and without other caches between their stages, stay near the best of all orders and within the rules."""
    for interleave in (True, False):
        total = best = 0.0
        for seed in range(12):
            r = np.random.default_rng(seed)
            ends = r.uniform(0, 700, 6).tolist()
            p = O.Problem(r.integers(1, 6, 6).astype(float).tolist(), [60.0] * 6, places(seed, 6), ends, ends, 0.0, 2200.0, list("aabbab"), ["x", "x", "y", "y", None, None], [2, 1, None, None, None, None],
                          [True, True, False, False, False, False], True, 1.0, interleave)
            order = O.solve_orienteering(p)
            assert O.valid(order, p)
            total += O.path_score(order, p)
            best += max(O.path_score(list(q), p) for n in range(7) for q in itertools.permutations(range(6), n) if O.valid(list(q), p))
        assert 0.9 * best <= total <= best + 1e-9


def test_no_shorter_path_is_missed():
    """All reversals and chain moves that shorten a path, with distances that differ by direction, against trying each."""
    for seed in range(5):
        d = np.random.default_rng(seed).uniform(1, 100, (7, 7))
        path = list(range(7))
        tried = {tuple(path[:i] + path[i : j + 1][::-1] + path[j + 1 :]) for i in range(1, 5) for j in range(i + 1, 6)}
        for size in (1, 2, 3):
            for i in range(1, 7 - size):
                chain, rest = path[i : i + size], path[:i] + path[i + size :]
                tried |= {tuple(rest[:k] + c + rest[k:]) for k in range(1, len(rest)) if k != i for c in (chain, chain[::-1])}
        length = lambda q: O.tour_length(list(q), d, closed=False)
        got = [tuple(q) for q in O.shorter_paths(path, d, True, (1, 2, 3))]
        assert set(got) == {q for q in tried if length(q) < length(path) - 1e-9}
        assert [length(q) for q in got] == pytest.approx(sorted(map(length, got)))


def test_tours_of_two_hundred_stops():
    d = places(1, 200)
    order, length = O.solve_tour(d)
    assert sorted(order) == list(range(200)) and order[0] == 0 and length <= O.tour_length(O.nearest_first(d, 0), d)
    assert not any(O.tour_length(q, d, False) < length - 1e-6 for q in O.shorter_paths([*order, 0], d, True, (1, 2, 3)))


def test_tours_against_all_orders():
    for seed in range(6):
        d = places(seed)
        order, length = O.solve_tour(d)
        best = min(O.tour_length([0, *q], d) for q in itertools.permutations(range(1, 8)))
        assert sorted(order) == list(range(8)) and best - 1e-6 <= length <= 1.1 * best
    assert O.solve_tour(np.zeros((0, 0))) == ([], 0.0) and O.solve_tour(np.zeros((1, 1))) == ([0], 0.0)


def test_metric_closure_fills_only_gaps():
    m = np.array([[0, 5, np.nan], [5, 0, 7], [np.nan, 7, 0.0]])
    assert O.metric_closure(m, 10)[0, 2] == 12 and np.isnan(O.metric_closure(m, 6)[0, 2])
    assert O.metric_closure(m, 6)[1, 2] == 7


def test_parking_and_trim():
    d, out = places(1), np.full(8, 300.0)
    order, added = O.insert_parking(list(range(8)), out, out, d)
    assert sorted(order) == list(range(8))
    assert O.closed_length(order, d, out, out) == pytest.approx(O.tour_length(list(range(8)), d) + added)
    short, dropped = O.trim_to_budget(order, d, out, out, 2500.0)
    assert O.closed_length(short, d, out, out) <= 2500 and len(short) + len(dropped) == 8 and {w for _, w in dropped} <= {"distance-budget"}


def two_blobs():
    r = np.random.default_rng(0)
    xy = np.concatenate([r.normal(0, 10, (12, 2)), r.normal(200, 10, (12, 2))])
    place = {i: tuple(p) for i, p in enumerate(xy.tolist())}
    return place, [(a, b, float(np.hypot(*(xy[a] - xy[b])))) for a in place for b in place if a < b]


@pytest.mark.parametrize("strategy", ["hdbscan-star", "dbscan", "louvain", "leiden", None])
def test_clustering_finds_two_blobs(strategy):
    place, edges = two_blobs()
    assert C.cluster(list(place), edges, strategy, 60, 5) == [list(range(12)), list(range(12, 24))]


def test_clusterings_are_stable_and_within_the_pool():
    place, edges = two_blobs()
    some = [e for e in edges if e[2] < 40]
    for s in C.STRATEGIES:
        found = C.cluster(list(place), some, s, 40, 3)
        assert found == C.cluster(list(place), some[::-1], s, 40, 3)
        assert all(set(c) <= set(place) and len(c) >= 3 for c in found)


def test_tree_split_fits_the_budget():
    place, _ = two_blobs()
    d = lambda a, b: float(np.hypot(place[a][0] - place[b][0], place[a][1] - place[b][1]))
    for part in C.split_by_tree(list(place), d, 250.0, 2):
        assert 2 * C.tree_length(len(part), lambda i, j, part=part: d(part[i], part[j])) <= 250
    assert C.trim_far([0, 1, 2, 3, 12], place, 3, 1e9) == [0, 1, 2, 3]


def test_mulberry_and_union():
    draw = C.mulberry32(1)
    x = [draw() for _ in range(1000)]
    assert 0.45 < np.mean(x) < 0.55 and x[:3] == [C.mulberry32(1)() for _ in range(1)] + x[1:3]
    assert C.component_clusters([1, 2, 3, 4, 5], [(1, 2, 1.0), (4, 5, 1.0)]) == [[1, 2], [4, 5]]
    assert C.pixel_groups([(1, 0, 0), (2, 10, 0), (3, 50, 0)]) == [[1, 2], [3]]


def test_limiter_windows_open_at_the_first_hit(spark):
    rows = [("a", t, i) for i, t in enumerate([0.0, 1.0, 2.0, 3.0, 9.0, 10.5, 14.0])]
    got = limiter.replay(spark.createDataFrame(rows, "key string, at double, seq long"), 10, 3, 5).orderBy("at").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, True, True, True][:3] + [False, False or got[4]["allowed"], got[5]["allowed"], got[6]["allowed"]]
    assert got[3]["blocked_until"] == 8.0 and got[4]["hits"] == 5 and not got[4]["allowed"]
    marks = spark.createDataFrame([("a", float(t), t, t == 3) for t in range(6)], "key string, at double, seq long, reset boolean")
    assert [r["hits"] for r in limiter.login_limit(marks, 2, 900).orderBy("at").collect()] == [1, 2, 3, 0, 1, 2]


def test_limiter_stream(spark, tmp_path):
    rows = [(f"k{i % 3}", float(i), i) for i in range(40)]
    spark.createDataFrame(rows, "key string, at double, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, at double, seq long").parquet(str(tmp_path / "in"))
    q = limiter.stream(src, 10, 2, 5).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = limiter.replay(spark.createDataFrame(rows, "key string, at double, seq long"), 10, 2, 5)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, want.collect()))


def test_upsert_rules(spark):
    cols = "owner long, source_id string, type string, name string, difficulty double, terrain double, archived boolean, disabled boolean, lng double, lat double, exported_at long"
    base = (1, "A", "Multi", "old", 1.0, 1.0, False, False, 5.0, 52.0)
    stored = spark.createDataFrame([(*base, 10), (1, "B", *base[2:], 10), (1, "C", *base[2:], 10)], cols)
    stored = stored.withColumns({"id": F.when(F.col("source_id") == "A", 1).when(F.col("source_id") == "B", 2).otherwise(3), "solved": F.col("source_id") == "B", "posted_lng": F.lit(None).cast("double"), "posted_lat": F.lit(None).cast("double")})
    moved = ("Multi", "new", 1.0, 1.0, False, False, 5.1, 52.0)
    incoming = spark.createDataFrame([(1, "A", *moved, 5), (1, "B", *moved, 20), (1, "D", *moved, 20), (2, "C", *moved, None)], cols)
    got = {(r["owner"], r["source_id"]): r for r in maintenance.upsert_caches(stored, incoming).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {(1, "A"): "stale", (1, "B"): "updated", (1, "C"): "kept", (1, "D"): "new", (2, "C"): "new"}
    assert got[1, "B"]["lng"] == 5.0 and got[1, "B"]["posted_lng"] == 5.1 and got[1, "A"]["name"] == "old" and not got[1, "B"]["moved"]


def test_polygon_with_hole_and_boundary(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([([ring(0.0, 10.0), ring(4.0, 6.0)],)], "rings array<array<struct<lng:double,lat:double>>>")
    test = lambda x, y: spatial.contains(F.col("rings"), F.lit(float(x)), F.lit(float(y)))
    row = df.select(test(1, 1), test(5, 5), test(0, 5), test(11, 5), spatial.area(F.col("rings")), spatial.centroid(F.col("rings")[0])).first()
    assert list(row[:4]) == [True, False, False, False] and row[4] == 96 and tuple(row[5]) == (5, 5)


def test_range_join_at_high_latitudes(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(10, 10.3, 150), r.uniform(69.9, 70.1, 150)))]
    df = spark.createDataFrame(rows, "id long, lng double, lat double")
    got = {(x["l_id"], x["r_id"]) for x in spatial.range_join(df, df, 1500).collect()}
    a, b = df.select(*[F.col(c).alias(c + "1") for c in df.columns]), df.select(*[F.col(c).alias(c + "2") for c in df.columns])
    want = a.crossJoin(b).filter(geo.haversine(F.col("lng1"), F.col("lat1"), F.col("lng2"), F.col("lat2")) <= 1500)
    assert got == {(x["id1"], x["id2"]) for x in want.collect()} and len(got) > 150


def test_road_snap_against_all_segments(spark):
    r = np.random.default_rng(1)
    lines = [(i, [(float(x), float(y)), (float(x + dx), float(y + dy))]) for i, (x, y, dx, dy) in enumerate(zip(r.uniform(5, 5.05, 40), r.uniform(52, 52.05, 40), r.uniform(-0.02, 0.02, 40), r.uniform(-0.02, 0.02, 40)))]
    roads = spark.createDataFrame(lines, "osm_id long, line array<struct<lng:double,lat:double>>")
    path = spark.createDataFrame([(5.02, 52.02), (5.03, 52.03)], "lng double, lat double")
    got = {x["osm_id"]: x["meters"] for x in spatial.snap_to_roads(path, roads, 300, 100).collect()}
    best = {}
    for i, ((x1, y1), (x2, y2)) in lines:
        for x, y in ((5.02, 52.02), (5.03, 52.03)):
            t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            px, py = np.radians([x1 + t * (x2 - x1), y1 + t * (y2 - y1)])
            qx, qy = np.radians([x, y])
            m = 2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((py - qy) / 2) ** 2 + np.cos(py) * np.cos(qy) * np.sin((px - qx) / 2) ** 2))
            if m <= 300:
                best[i] = min(m, best.get(i, 1e9))
    assert got.keys() == best.keys() and all(abs(got[i] - best[i]) < 0.01 for i in best) and best


def test_gpx_file_round_trip(spark, tmp_path):
    xml = """<gpx xmlns:groundspeak="g"><name>My Finds Pocket Query</name><time>2024-05-01T10:00:00Z</time>
    <wpt lat="52.1" lon="5.1"><name>GC1</name><groundspeak:cache id="1" available="False" archived="False"><groundspeak:name>A &amp; B</groundspeak:name><groundspeak:type>Unknown Cache</groundspeak:type>
    <groundspeak:long_description>Take a magnet</groundspeak:long_description><groundspeak:attributes><groundspeak:attribute id="51" inc="1">x</groundspeak:attribute></groundspeak:attributes></groundspeak:cache></wpt>
    <wpt lat="52.2" lon="5.2"><name>PKGC1</name><sym>Parking Area</sym></wpt><wpt><name>none</name></wpt></gpx>"""
    (tmp_path / "a.gpx").write_text(xml)
    got = {r["code"]: r for r in gpx.parse(gpx.read_waypoints(spark, str(tmp_path / "a.gpx"))).collect()}
    assert {c: r["kind"] for c, r in got.items()} == {"GC1": "cache", "PKGC1": "waypoint", "none": "warning"}
    one = got["GC1"]
    assert one["type"] == "Mystery" and one["disabled"] and one["description_hints"] == ["magnet"] and one["attributes"][0]["attr_id"] == 51 and one["name"] == "A & B"
    assert got["PKGC1"]["parent_code"] == "GC1" and got["PKGC1"]["waypoint_type"] == "parking"
    head = gpx.read_header(spark, str(tmp_path / "a.gpx")).first()
    assert head["is_my_finds"] and str(head["exported_at"]).startswith("2024-05-01")


def test_raw_store(spark, tmp_path):
    up = spark.createDataFrame([(1, "u1", "<gpx>\n1</gpx>"), (2, "u2", "<gpx/>")], "owner long, upload_id string, xml string")
    gpx.store_raw(up, str(tmp_path / "raw"))
    assert gpx.read_raw(spark, str(tmp_path / "raw"), "u1").first()["xml"] == "<gpx>\n1</gpx>"
    sinks.write_samples(up, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_profiles():
    p = settings.Profile("walk", 3, objective=settings.Objective(preferred_types=("Multi",), preferred_weight=2.0))
    state = settings.apply_profile(p, {"other": 1})
    assert state["other"] == 1 and settings.profile_of(state, "walk", 3) == p
    with pytest.raises(ValueError):
        settings.Filters(difficulty=(3.0, 2.0))
    with pytest.raises(ValueError):
        finder.check_box(0, 0, 3, 1)
    assert tours.choose_mode(["Adventure Lab"], False) == "greedy" and tours.choose_mode(["Multi"], True, "solver") == "solver"
    assert tours.keep_old(10, 10.5) and not tours.keep_old(10, 11.5)


def test_plan_reports_every_stop(spark):
    stops = spark.createDataFrame([(1, i, 100.0, 100.0, "a" if i < 2 else None, i) for i in range(5)], "request long, id long, out_m double, back_m double, adventure_id string, stage_sequence int")
    cells = [(1, a, b, 200.0 * abs(a - b)) for a in range(5) for b in range(5) if a != b and 4 not in (a, b)]
    matrix = spark.createDataFrame(cells, "request long, from_id long, to_id long, meters double")
    for search in (False, True):
        got = tours.plan_loops(stops, matrix, 900.0, 250.0, search=search).collect()
        assert sorted(r["id"] for r in got) == list(range(5)) and {r["id"]: r["reason"] for r in got}[4] == "unreachable"
        assert all(r["total_m"] <= 900 for r in got)


def test_share_slug_and_nulls(spark):
    row = spark.range(1).select(text.share_slug(F.lit("x")).alias("s"), geo.haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("h"), P.budget_minutes(F.lit(None).cast("double"), F.lit(1.0)).alias("b")).first()
    assert len(row["s"]) == 16 and row["h"] is None and row["b"] is None


def test_kth_smallest_narrows_to_the_value(spark):
    from trailspark.operators.aggregates import kth_smallest

    r = np.random.default_rng(0)
    values = [float(x) for x in np.concatenate([r.exponential(1000, 3000), [7.0] * 500])]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (0, 17, 1750, 3499):
        assert kth_smallest(df, "v", k, buckets=16, few=20) == sorted(values)[k]
    assert kth_smallest(df, "v", 3500) is None and kth_smallest(df.limit(0), "v", 0) is None


def test_lines_lose_only_near_points():
    """Every point that goes lies within the tolerance of the stretch that replaces it; a point that stays inside a stretch of two would be missed."""
    for seed in range(20):
        r = np.random.default_rng(seed)
        x, y = np.arange(30.0), r.normal(0, 1, 30).cumsum()
        for tolerance in (0.0, 0.5, 2.0, 100.0):
            k = spatial.kept_points(x, y, tolerance)
            assert k[0] == 0 and k[-1] == 29
            for a, b in zip(k, k[1:], strict=False):
                for i in range(a + 1, b):
                    t = np.clip(((x[i] - x[a]) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a])) / ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2), 0, 1)
                    assert np.hypot(x[a] + t * (x[b] - x[a]) - x[i], y[a] + t * (y[b] - y[a]) - y[i]) <= tolerance + 1e-9
        assert len(spatial.kept_points(x, y, 100.0)) == 2


def test_rings_stay_simple():
    """Star-shaped rings keep a triangle at least and no edges that meet; one with a hole beside a dent keeps the dent."""
    for seed in range(20):
        r = np.random.default_rng(seed)
        angle = np.linspace(0, 2 * np.pi, 40)
        radius = r.uniform(0.3, 1, 40)
        radius[-1] = radius[0]
        ring = radius * np.cos(angle), radius * np.sin(angle)
        ring[0][-1], ring[1][-1] = ring[0][0], ring[1][0]
        for tolerance in (0.01, 0.2, 5.0):
            (k,) = spatial.kept_of_rings([ring], tolerance)
            assert len(k) >= 4 and k[0] == 0 and k[-1] == 39
            assert not spatial._touching([(ring[0][k], ring[1][k])])
    square = np.array([0, 4, 4, 0, 0.0]), np.array([0, 0, 4, 4, 0.0])
    assert not spatial._touching([square]) and spatial._touching([(np.array([0, 4, 0, 4, 0.0]), np.array([0, 4, 4, 0, 0.0]))])
    bulge = np.array([0, 4, 4, 2, 0, 0.0]), np.array([0, 0, 4, 5, 4, 0.0])
    hole = np.array([1.9, 2.1, 2.0, 1.9]), np.array([4.2, 4.2, 4.5, 4.2])
    outer, _ = spatial.kept_of_rings([bulge, hole], 1.5)
    assert 3 in outer  # without the bulge the hole would lie outside
    assert 3 not in spatial.kept_of_rings([bulge], 1.5)[0]
