"""What the review of round 3 found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_findings_r02 import boxes, crowd, stacked  # noqa: F401
from trailspark.operators import spatial as S
from trailspark.plans.bindings import shared_checkpoint


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def crowded(spark):
    xy = crowd(600)
    return spark.createDataFrame([(i, i % 2, float(5 + x / 68_000), float(52 + y / 111_000)) for i, (x, y) in enumerate(xy)], "id long, owner long, lng double, lat double")


def test_no_plan_holds_the_walking_graph(spark, crowded):
    """The driver planned every radius' join at each mention of the graph."""
    from trailspark.operators import graph as G
    from trailspark.plans.q_spatial import legs_of

    plain = G.walking_graph(crowded, legs_of, 4, 4000, 3000)
    kept = G.walking_graph(crowded, legs_of, 4, 4000, 3000, keep=shared_checkpoint)
    assert sorted(kept.collect()) == sorted(plain.collect())
    assert "Join" in plan(plain) and "Join" not in plan(kept)


@pytest.mark.parametrize("name", ["gr03_seeds", "gr04_subgraphs", "gr08_dbscan", "gr11_hdbscan_star", "gr12_mutual_reach", "gr15_default", "gr17_trim_loose"])
def test_queries_plan_the_graph_once(spark, name):
    """F2, F4-F6, F8-F10."""
    from trailspark.plans.bindings import QUERIES
    from trailspark.plans import driver_queries  # noqa: F401

    assert "cell_band" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_radii_hold_each_other_once(spark, crowded):
    """A radius' neighbours are cut off from what made them, and are those of all pairs."""
    held = []
    keep = lambda df: held.append(df) or shared_checkpoint(df)
    rows = lambda df: sorted((r["from_id"], r["to_id"], r["rank"]) for r in df.collect())
    assert rows(S.nearest_neighbours(crowded, crowded, 5, 3000, keep)) == rows(S.nearest_neighbours(crowded, crowded, 5, 3000))
    assert len(held) == len(S._radii(crowded, 5, 3000)) - 1 > 0


def test_no_plan_holds_the_cells_of_polygons(spark, stacked):  # noqa: F811
    """cells of polygons were planned six times over."""
    at, points, rows = stacked
    kept = S.landuse_of_points(points, boxes(spark, rows), keep=shared_checkpoint)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in S.landuse_of_points(points, boxes(spark, rows)).collect()}
    assert plan(kept).count("edges") == 0


def test_smallest_of_stacked_polygons(spark, stacked):  # noqa: F811
    """of many polygons around a point few are tested."""
    at, points, rows = stacked
    areas = boxes(spark, rows).withColumn("name", F.concat(F.lit("Area "), F.col("osm_id").cast("string")))
    held = []
    got = {r["id"]: r["name"] for r in S.smallest_around(points, areas, keep=lambda df: held.append(df) or df).collect()}
    want = {}
    for i, (x, y) in enumerate(at):
        around = [((e - w) * (n - s), k) for k, _, w, s, e, n in rows if w < x < e and s < y < n]
        if around:
            want[i] = f"Area {min(around)[1]}"
    assert got == want
    pairs = sum(w < x < e and s < y < n for _, _, w, s, e, n in rows for x, y in at)
    assert held[1].agg(F.sum(F.size("keys"))).first()[0] < 0.2 * pairs


def test_tree_by_rows_equals_tree_of_pairs():
    """large pools are split by their tree."""
    from trailspark.operators import cluster as K

    xy = np.round(crowd(250), -1)  # many equal distances
    place = {3 * i + 1: (float(x), float(y)) for i, (x, y) in enumerate(xy)}
    far = lambda a, b: float(np.hypot(place[a][0] - place[b][0], place[a][1] - place[b][1]))
    ids = sorted(place)
    adj = K.neighbours([(a, b, 0.9 * far(a, b)) for s in (1, 7) for a, b in zip(ids, ids[s:])])  # noqa: B905
    near = lambda a, b: min(adj.get(a, {}).get(b, np.inf), far(a, b) * 1.3)
    for some in (ids, ids[5:120], ids[:2], ids[:1], []):
        assert K.least_tree_planar(some, place, 1.3, adj) == K.least_tree(some, near)
    assert K.tree_length_planar(xy) == K.tree_length(250, lambda i, j: float(np.hypot(*(xy[i] - xy[j]))))


def test_discovery_takes_the_whole_pool(spark):
    """only 2 000 nodes next to the centre were looked at."""
    from trailspark.plans import q_graph as Q

    rng = np.random.default_rng(4)
    at = rng.uniform(-0.05, 0.05, (2500, 2)) + (5.1, 52.1)
    rows = [(i, 3, f"GC{i}", "Multi", f"n{i}", float(x), float(y), 1.0, 1.0, False, False, False, 0, None, None, 0) for i, (x, y) in enumerate(at)]
    names = "id long, owner long, code string, type string, name string, lng double, lat double, difficulty double, terrain double, archived boolean, disabled boolean, solved boolean, stage_count long, adventure_id string, stage_sequence int, ts long"
    pool, _, edges = Q.D.prepare(spark.createDataFrame(rows, names), Q.legs_of, Q._request(), shared_checkpoint)
    assert pool.count() == 2500
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    assert ends.count() > 2400
