"""Queries that SQL can't express, against plain computations over the same tables."""

import collections
import math

import numpy as np
import pytest

from trailspark.plans import driver_queries
from trailspark.plans.bindings import entity

QUERIES = driver_queries.queries()
SF = "/root/testdata/sf0.01"


def result(spark, name):
    return QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def caches(spark):
    return entity(spark, SF, "caches").toPandas().sort_values("id").set_index("id")


@pytest.fixture(scope="module")
def edges(spark):
    return result(spark, "gr01_walking_graph")


def metres(a, b):
    """Great-circle distances of (lng, lat) rows."""
    (x1, y1), (x2, y2) = np.radians(np.asarray(a, float).T), np.radians(np.asarray(b, float).T)
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_008.8 * np.arcsin(np.sqrt(h))


def plane(rows):
    """Metres around (5.1, 52.1)."""
    p = math.radians(52.1)
    east = 111_412.84 * math.cos(p) - 93.5 * math.cos(3 * p) + 0.118 * math.cos(5 * p)
    north = 111_132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p)
    return np.column_stack([(rows["lng"] - 5.1) * east, (rows["lat"] - 52.1) * north])


def owners(caches):
    for owner, rows in caches.groupby("owner"):
        xy = plane(rows)
        yield owner, rows.index.to_numpy(), np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))


def components(ids, near):
    """Each node's smallest reachable one."""
    least = np.arange(len(ids))
    while True:
        new = np.array([least[near[i] | (np.arange(len(ids)) == i)].min() for i in range(len(ids))])
        if (new == least).all():
            return least
        least = new


def instances(caches, size):
    """Ids of each instance in order."""
    out = {}
    for owner, rows in caches.groupby("owner"):
        ids = rows.index.to_numpy()
        for k in range(0, len(ids), size):
            out[owner * 1_000_000 + k // size] = ids[k : k + size]
    return out


def test_tree_lengths(spark, caches):
    got = result(spark, "gr21_tree_length").set_index("owner")["meters"]
    for owner, ids, d in owners(caches):
        i, j = np.triu_indices(len(ids), 1)
        root, total = list(range(len(ids))), 0.0

        def top(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for e in np.argsort(d[i, j]):  # Kruskal
            a, b = top(i[e]), top(j[e])
            if a != b:
                root[a], total = b, total + d[i[e], j[e]]
        assert got[owner] == pytest.approx(total, abs=0.02)


def test_colocated(spark, caches):
    got = {(int(o), int(r), int(n)) for o, r, n in result(spark, "gr06_colocated").itertuples(index=False)}
    want = set()
    for owner, ids, d in owners(caches):
        least = components(ids, d <= 400)
        for c in set(least):
            members = ids[least == c]
            want.add((owner, min(members, key=lambda m: (m % 5, m)), len(members)))
    assert got == want and any(n > 1 for _, _, n in got)


def test_density_clusters(spark, caches):
    got = result(spark, "gr09_dbscan_planar")
    assert len(got) > 100
    for owner, ids, d in owners(caches):
        near = d <= 1500
        core = near.sum(axis=1) >= 3
        own = got[got["owner"] == owner].set_index("id")["cluster"]
        cluster = np.array([own.get(i, -1) for i in ids])
        assert ((cluster >= 0) == (near & core[None]).any(axis=1)).all()  # cores and what they reach
        least = components(ids[core], near[np.ix_(core, core)])
        assert len(set(zip(least, cluster[core], strict=True))) == len(set(least)) == len(set(cluster[core]))
        for k in np.flatnonzero(~core & (cluster >= 0)):
            assert cluster[k] in cluster[near[k] & core]


def test_subgraphs_against_all_paths(spark, caches, edges):
    got = result(spark, "gr04_subgraphs")
    want = {}
    for owner, rows in caches.groupby("owner"):
        at = {i: k for k, i in enumerate(rows.index)}
        d = np.full((len(at), len(at)), np.inf)
        np.fill_diagonal(d, 0)
        for a, b, m in zip(edges["from_id"], edges["to_id"], edges["meters"], strict=True):
            if a in at:
                d[at[a], at[b]] = d[at[b], at[a]] = m
        for k in range(len(d)):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
        for seed in got.loc[got["owner"] == owner, "seed"].unique():
            want |= {(seed, i): d[at[seed], at[i]] for i in at if d[at[seed], at[i]] <= 4000}
    found = {(s, i): m for s, i, m in zip(got["seed"], got["id"], got["meters"], strict=True)}
    assert found.keys() == want.keys() and len(found) > 500
    assert all(abs(found[k] - want[k]) < 0.1 for k in found)


@pytest.mark.parametrize("name", ["gr08_dbscan", "gr10_hdbscan", "gr11_hdbscan_star", "gr13_louvain", "gr14_leiden", "gr15_default"])
def test_clusters_are_linked(spark, caches, edges, name):
    """No node twice in a cluster (or in two, but for sweeps over resolutions), none of another owner, and each cluster's nodes hang together in the graph."""
    got = result(spark, name)
    sweep = name in ("gr13_louvain", "gr14_leiden")
    assert len(got) and not got.duplicated(["id", "owner", "cluster"] if sweep else "id").any()
    assert (caches.loc[got["id"], "owner"].to_numpy() == got["owner"].to_numpy()).all()
    beside = collections.defaultdict(set)
    for a, b in zip(edges["from_id"], edges["to_id"], strict=True):
        beside[a].add(b)
        beside[b].add(a)
    clusters = [frozenset(rows["id"]) for _, rows in got.groupby(["owner", "cluster"])]
    assert len(set(clusters)) == len(clusters)
    for members in clusters:
        seen, todo = set(), [next(iter(members))]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += beside[v] if name in ("gr10_hdbscan", "gr11_hdbscan_star", "gr15_default") else beside[v] & members
        assert members <= seen


def test_tours_hold_every_stop(spark, caches):
    got = result(spark, "pl05_tours")
    own = instances(caches, 60)
    assert set(got["instance"]) == set(own)
    for instance, rows in got.groupby("instance"):
        ids, order = own[instance], rows.sort_values("seq")["stop"].to_numpy()
        assert sorted(order) == list(range(len(ids))) and order[0] == 0
        xy = caches.loc[ids[order], ["lng", "lat"]].to_numpy()
        assert metres(xy, np.roll(xy, -1, axis=0)).sum() == pytest.approx(rows["total_m"].iloc[0], abs=0.02)


@pytest.mark.parametrize("name, variety", [("pl06_orienteering", 1.0), ("pl07_whole_adventures", 0.0)])
def test_walks_keep_their_budget(spark, caches, name, variety):
    got = result(spark, name)
    own = instances(caches, 60)
    assert len(got) > 100
    for instance, rows in got.groupby("instance"):
        ids = own[instance][rows.sort_values("seq")["stop"].to_numpy()]
        assert len(set(ids)) == len(ids)
        xy = np.vstack([[5.1, 52.1], caches.loc[ids, ["lng", "lat"]].to_numpy(), [5.1, 52.1]])
        seconds = metres(xy[:-1], xy[1:]).sum() / 1.4 + 300 * len(ids)
        assert seconds == pytest.approx(rows["seconds"].iloc[0], abs=0.02) and seconds <= 4 * 3600
        kinds = collections.defaultdict(list)
        for i in ids:
            kinds[caches.loc[i, "type"]].append(1 + i % 4)
        score = sum(p / (1 + variety * k / 2) for prizes in kinds.values() for k, p in enumerate(sorted(prizes, reverse=True)))
        assert score == pytest.approx(rows["score"].iloc[0], abs=0.01)
        if name == "pl07_whole_adventures":
            adventures = caches.loc[own[instance], "adventure_id"].dropna()
            for _, members in adventures.groupby(adventures):
                at = [list(ids).index(m) for m in members.index if m in ids]
                assert not at or (len(at) == len(members) and max(at) - min(at) == len(at) - 1)


@pytest.mark.parametrize("name, budget", [("pl18_greedy_plan", 40_000), ("pl19_solver_plan", 40_000)])
def test_plans_account_for_every_cache(spark, caches, name, budget):
    got = result(spark, name)
    assert sorted(got["id"]) == sorted(caches.index)
    for instance, ids in instances(caches, 60).items():
        rows = got[got["request"] == instance]
        assert set(rows["id"]) == set(ids)
        stops = rows[rows["kind"] == "stop"].sort_values("seq")
        assert rows[rows["kind"] == "dropped"]["reason"].notna().all()
        if len(stops):
            xy = np.vstack([[5.1, 52.1], caches.loc[stops["id"], ["lng", "lat"]].to_numpy(), [5.1, 52.1]])
            length = 1.3 * metres(xy[:-1], xy[1:]).sum()
            assert length == pytest.approx(stops["total_m"].iloc[0], abs=0.05) and length <= budget + 0.05


def test_vias_lie_beside_their_legs(spark):
    got = result(spark, "pl15_via_candidates").merge(entity(spark, SF, "pairs").toPandas(), on="id")
    got = got[got["via"].notna()]
    scale = 111_320 * np.cos(np.radians(got["lat1"].to_numpy()))
    x, y = (got["lng2"] - got["lng1"]).to_numpy() * scale, (got["lat2"] - got["lat1"]).to_numpy() * 111_320
    px, py = (np.array([v["lng"] for v in got["via"]]) - got["lng1"]) * scale, (np.array([v["lat"] for v in got["via"]]) - got["lat1"]) * 111_320
    n = np.hypot(x, y)
    assert np.allclose((x * py - y * px) / n, got["offset"], atol=0.01)
    assert np.allclose((x * px + y * py) / n**2, got["fraction"], atol=1e-5) and len(got) > 1000


def test_slugs(spark):
    got = result(spark, "fn38_share_slug")
    assert got["slug"].str.fullmatch("[a-z2-7]{16}").all() and not got["slug"].duplicated().any()


def test_road_snaps(spark, caches):
    got = result(spark, "jn13_road_snap")
    roads = entity(spark, SF, "parking").toPandas()
    best = []
    points = caches.loc[caches["owner"] == 3, ["lng", "lat"]].to_numpy()
    for _, r in roads.iterrows():
        a = np.array([r["lng"], r["lat"]])
        d = np.array([0.004, (r["id"] % 5 - 2) * 0.001])
        t = np.clip(((points - a) @ d) / (d @ d), 0, 1)
        q = a + t[:, None] * d
        m = metres(points, q)
        best.append((m.min(), r["id"]))
    want = sorted(b for b in best if b[0] <= 400)[: len(got)]
    assert len(got) and [int(i) for _, i in want] == got["osm_id"].tolist()
    assert np.allclose([m for m, _ in want], got["meters"], atol=0.01)
