"""Discovery: from a request's filtered pool to ranked clusters, and explanations of a given selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.geo import planar, pool_radius  # noqa: F401
from trailspark.functions.planning import cluster_id
from trailspark.operators import cluster as K
from trailspark.operators import finder as X
from trailspark.operators.aggregates import growth_pool
from trailspark.operators.graph import collapse_adventures, walking_graph
from trailspark.operators.optimise import estimate_length
from trailspark.operators.scoring import Wishes, rank, score_clusters


@dataclass
class Request:
    find: X.Find
    wishes: Wishes
    k: int = 5
    link_m: float = 800.0
    least: int = 4
    strategy: str | None = None
    grow: bool = False
    skip: frozenset[str] = field(default_factory=frozenset)


def distances(place: dict[int, tuple[float, float]]):
    return lambda a, b: float(np.hypot(place[a][0] - place[b][0], place[a][1] - place[b][1]))


def prepare(caches: DataFrame, legs, r: Request, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, **finder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool, stands_for, edges): all nodes that the request finds, adventures collapsed, and their walking graph.

    The pool is kept, for the graph mentions it again and again: ``keep`` persists it, or checkpoints it, so that no plan holds what made it.
    """
    margin = r.wishes.budget_m // 2 if r.grow else 0.0
    found = X.find(caches, X.Find(**{**r.find.__dict__, "radius_m": r.find.radius_m + margin}), **finder)
    groups = collapse_adventures(found.select("id", "lng", "lat", "adventure_id"))
    pool = keep(growth_pool(found.join(groups, "id"), r.find.center, r.find.radius_m, r.find.radius_m + margin))
    edges = walking_graph(pool.select("id", "owner", "lng", "lat"), legs, r.k, 3 * r.link_m, r.link_m, keep=keep)
    return pool, groups, edges


def clusters(pool: DataFrame, edges: DataFrame, r: Request, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(cluster, id, tree_m, tour_m) of the request's refined clusters: one task, for a pool is of one owner."""
    x, y = planar(F.col("lng"), F.col("lat"), *r.find.center)
    nodes = pool.select(F.lit(0).alias("request"), "id", x.alias("x"), y.alias("y"), "in_radius")
    links = edges.select(F.lit(0).alias("request"), "from_id", "to_id", "meters")

    def run(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        place = {int(i): (a, b) for i, a, b in zip(own["id"], own["x"], own["y"], strict=True)}
        es = list(zip(graph["from_id"].tolist(), graph["to_id"].tolist(), graph["meters"].tolist(), strict=True))
        adj, far = K.neighbours(es), distances(place)
        near = lambda a, b: min(adj.get(a, {}).get(b, np.inf), far(a, b) * 1.3)
        raw = K.cluster(sorted(place), es, r.strategy, r.link_m, r.least)
        inside = set(own.loc[own["in_radius"], "id"].tolist())
        out = []
        kept = [c for c in K.refine(raw, adj, place, near, r.wishes.budget_m, r.least, r.skip, lambda c: K.least_tree_planar(c, place, 1.3, adj)) if inside & set(c)]
        for n, c in enumerate(kept):
            xy = np.array([place[i] for i in c])
            tree = K.tree_length_planar(xy)
            tour = estimate_length(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))) if len(c) <= 40 else 1.4 * 1.3 * tree
            out += [(n, i, tree, tour) for i in c]
        return pd.DataFrame(out, columns=["n", "id", "tree_m", "tour_m"])

    found = nodes.groupBy("request").cogroup(links.groupBy("request")).applyInPandas(run, "n long, id long, tree_m double, tour_m double")
    found = keep(found)
    name = found.groupBy("n").agg(cluster_id(F.sort_array(F.collect_list("id"))).alias("cluster"))
    return found.join(name, "n").drop("n")


def discover(caches: DataFrame, legs, kinds: DataFrame, parking: DataFrame, r: Request, most: int = 5, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, **finder) -> DataFrame:
    """(cluster, size, total, breakdown, cache_ids): the best clusters, with all stages of adventures in place of the one that stood for them.

    kinds: (id, kinds array), parking: (id, parking_m).
    """
    pool, _, edges = prepare(caches, legs, r, keep, **finder)
    # used several times over, as the pool is
    found = keep(clusters(pool, edges, r, keep))
    details = pool.select("id", "lng", "lat", "type", "difficulty", "terrain", "stands_for").join(kinds, "id", "left").join(parking, "id", "left")
    members = found.join(details, "id").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>"))).withColumn("attribute_ids", F.array().cast("array<int>"))
    best = rank(score_clusters(members, found.select("cluster", "tree_m", "tour_m").distinct(), r.wishes), most)
    ids = members.groupBy("cluster").agg(F.sort_array(F.flatten(F.collect_list("stands_for"))).alias("cache_ids"))
    return best.join(ids, "cluster")


def explain(pool: DataFrame, edges: DataFrame, selection: list[int], r: Request) -> DataFrame:
    """(strategy, clusters, best_alike, trimmed, tree_m): what each strategy makes of a selection on this graph."""
    x, y = planar(F.col("lng"), F.col("lat"), *r.find.center)
    nodes = pool.select(F.lit(0).alias("request"), "id", x.alias("x"), y.alias("y"))
    for end in ("from_id", "to_id"):
        edges = edges.join(pool.select(F.col("id").alias(end)), end, "left_semi")
    links = edges.select(F.lit(0).alias("request"), "from_id", "to_id", "meters")

    def run(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        place = {int(i): (a, b) for i, a, b in zip(own["id"], own["x"], own["y"], strict=True)}
        es = list(zip(graph["from_id"].tolist(), graph["to_id"].tolist(), graph["meters"].tolist(), strict=True))
        adj, far = K.neighbours(es), distances(place)
        mine = [i for i in selection if i in place]
        trimmed = K.trim_far(K.trim_walking(mine, adj), place, r.least, r.wishes.budget_m / 4)
        tree = K.tree_length(len(mine), lambda i, j: far(mine[i], mine[j]))
        out = []
        for s in K.STRATEGIES:
            found = K.cluster(sorted(place), es, s, r.link_m, r.least)
            out.append((s, len(found), max((K.jaccard(c, mine) for c in found), default=0.0), len(mine) - len(trimmed), tree))
        return pd.DataFrame(out, columns=["strategy", "clusters", "best_alike", "trimmed", "tree_m"])

    return nodes.groupBy("request").cogroup(links.groupBy("request")).applyInPandas(run, "strategy string, clusters long, best_alike double, trimmed long, tree_m double")
