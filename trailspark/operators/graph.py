"""The walking graph: construction, symmetry, seeds, subgraphs, components, trims."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import haversine, lit
from trailspark.functions.planning import impossible_detour, impossible_speed, suspicious_leg
from trailspark.operators.aggregates import both_ways, degree
from trailspark.operators.spatial import Keep, _as_it_is, nearest_neighbours

EDGE = "from_id long, to_id long, meters double, seconds double"


def overfetch(k: int) -> int:
    """Neighbours by the crow taken for k by foot."""
    return max(3 * k, k + 5)


def ranked_legs(candidates: DataFrame, legs: DataFrame, k: int, most_m: float) -> DataFrame:
    """The k best usable legs of each origin, by walked metres.  Candidates: from_id, to_id, meters (straight)."""
    l = legs.select("from_id", "to_id", F.col("meters").alias("walk_m"), F.col("seconds").alias("walk_s"))
    return _best_legs(candidates.select("from_id", "to_id", F.col("meters").alias("straight")).join(l, ["from_id", "to_id"]), k, most_m)


def _best_legs(joined: DataFrame, k: int, most_m: float) -> DataFrame:
    good = (
        F.col("walk_m").isNotNull() & (F.col("walk_m") <= lit(most_m)) & ~suspicious_leg(F.col("walk_m"), F.col("straight"))
        & ~impossible_speed(F.col("walk_m"), F.col("walk_s")) & ~impossible_detour(F.col("walk_m"), F.col("straight"))
    )
    order = Window.partitionBy("from_id").orderBy("walk_m", "to_id")
    return joined.filter(good).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("from_id", "to_id", F.col("walk_m").alias("meters"), F.col("walk_s").alias("seconds"))


def symmetrise(directed: DataFrame, mutual: bool = False) -> DataFrame:
    """Undirected edges (from_id < to_id): picked from either side, or from both; the lesser metres and the lesser seconds of the two, each on its own."""
    a, b = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    out = directed.groupBy(a.alias("from_id"), b.alias("to_id")).agg(F.min("meters").alias("meters"), F.min("seconds").alias("seconds"), F.count_distinct("from_id").alias("sides"))
    return (out.filter("sides = 2") if mutual else out).drop("sides")


def fill_degrees(mutual: DataFrame, directed: DataFrame, least: int, group: str) -> DataFrame:
    """Mutual edges, and for nodes with fewer than ``least`` of them their best directed picks, nodes in the order of their ids.

    The order decides, so each ``group`` (a request, bounded by its pool) is solved in one task.
    """
    m, d = mutual.withColumn("mutual", F.lit(True)), symmetrise_by(directed, group).withColumn("mutual", F.lit(False))
    rows = m.select(group, "from_id", "to_id", "meters", "seconds", "mutual").unionByName(d.select(group, "from_id", "to_id", "meters", "seconds", "mutual"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[tuple[int, int], tuple[float, float]] = {}
        count: dict[int, int] = defaultdict(int)
        options: dict[int, list[tuple[float, int, int, float]]] = defaultdict(list)
        for a, b, meters, seconds, both in zip(pdf["from_id"], pdf["to_id"], pdf["meters"], pdf["seconds"], pdf["mutual"], strict=True):
            if both:
                kept[a, b] = (meters, seconds)
                count[a] += 1
                count[b] += 1
            options[a].append((meters, a, b, seconds))
            options[b].append((meters, a, b, seconds))
        for node in sorted(options):
            for meters, a, b, seconds in sorted(options[node]):
                if count[node] >= least:
                    break
                if (a, b) not in kept:
                    kept[a, b] = (meters, seconds)
                    count[a] += 1
                    count[b] += 1
        g = pdf[group].iloc[0]
        return pd.DataFrame([(g, a, b, m, s) for (a, b), (m, s) in kept.items()], columns=[group, "from_id", "to_id", "meters", "seconds"])

    return rows.groupBy(group).applyInPandas(fill, f"{group} {mutual.schema[group].dataType.simpleString()}, {EDGE}")


def symmetrise_by(directed: DataFrame, group: str) -> DataFrame:
    a, b = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    return directed.groupBy(group, a.alias("from_id"), b.alias("to_id")).agg(F.min("meters").alias("meters"), F.min("seconds").alias("seconds"))


def walking_graph(points: DataFrame, legs: DataFrame | Callable[[DataFrame], DataFrame], k: int, radius_m: float, most_m: float, mutual: bool = False, keep: Keep = _as_it_is) -> DataFrame:
    """Edges of the walking graph of the points (id, owner, lng, lat).

    ``legs`` is a table, or a router: asked with the candidates (from_id, to_id, meters straight) alone, it answers with their legs and their ``straight``.
    ``keep`` (a checkpoint) holds each radius' neighbours and the edges, so that no plan holds what made them.
    """
    near = nearest_neighbours(points, points, overfetch(k), radius_m, keep)
    if not callable(legs):
        return keep(symmetrise(ranked_legs(near, legs, k, most_m), mutual))
    asked = legs(near).select("from_id", "to_id", "straight", F.col("meters").alias("walk_m"), F.col("seconds").alias("walk_s"))
    return keep(symmetrise(_best_legs(asked, k, most_m), mutual))


def seeds(points: DataFrame, edges: DataFrame, cell_degrees: float = 0.01) -> DataFrame:
    """(id): in each grid cell the node with the most edges, then the smallest id; nodes without edges aren't seeds.

    Square cells stand in for the hexagons that no library here offers.
    """
    d = points.join(degree(edges), "id").withColumn("cx", F.floor(F.col("lng") / lit(cell_degrees))).withColumn("cy", F.floor(F.col("lat") / lit(cell_degrees)))
    order = Window.partitionBy("cx", "cy").orderBy(F.desc("degree"), "id")
    return d.withColumn("r", F.row_number().over(order)).filter("r = 1").select("id")


def subgraphs(seed_ids: DataFrame, edges: DataFrame, budget_m: float, group: str) -> DataFrame:
    """(group, seed, id, meters): what each seed reaches within half the budget, seeds that reach nothing aside.

    Shortest paths from all seeds of one group's graph; both sides carry ``group``.
    """
    kind = edges.schema[group].dataType.simpleString()

    def reach(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        adj: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for a, b, m in zip(graph["from_id"], graph["to_id"], graph["meters"], strict=True):
            adj[a].append((b, m))
            adj[b].append((a, m))
        out = []
        for seed in sorted(own["id"]):
            best, heap = {seed: 0.0}, [(0.0, seed)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > best[v]:
                    continue
                for w, m in adj[v]:
                    if d + m <= budget_m / 2 and d + m < best.get(w, float("inf")):
                        best[w] = d + m
                        heapq.heappush(heap, (d + m, w))
            if len(best) >= 2:
                out += [(own[group].iloc[0], seed, v, d) for v, d in best.items()]
        return pd.DataFrame(out, columns=[group, "seed", "id", "meters"])

    return seed_ids.groupBy(group).cogroup(edges.groupBy(group)).applyInPandas(reach, f"{group} {kind}, seed long, id long, meters double")


def collapse_adventures(caches: DataFrame) -> DataFrame:
    """(id, stands_for array): each adventure by the stage next to its mean (then the smallest id), other caches by themselves."""
    is_stage = F.col("adventure_id").isNotNull()
    stages = caches.filter(is_stage)
    mean = stages.groupBy("adventure_id").agg(F.avg("lng").alias("mx"), F.avg("lat").alias("my"), F.sort_array(F.collect_list("id")).alias("stands_for"))
    d = (F.col("lng") - F.col("mx")) * (F.col("lng") - F.col("mx")) + (F.col("lat") - F.col("my")) * (F.col("lat") - F.col("my"))
    medoid = stages.join(mean, "adventure_id").groupBy("adventure_id").agg(F.min_by(F.struct("id", "stands_for"), F.struct(d.alias("d"), F.col("id"))).alias("m")).select("m.id", "m.stands_for")
    return medoid.unionByName(caches.filter(~is_stage).select("id", F.array("id").alias("stands_for")))


def components(nodes: DataFrame, edges: DataFrame, checkpoint, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each node reaches, by label propagation with shortcuts.

    ``checkpoint`` cuts the lineage of each round (a function from DataFrame to DataFrame).
    """
    labels = checkpoint(nodes.select("id", F.col("id").alias("component")))
    pairs = checkpoint(both_ways(edges).select("id", "other").distinct())
    for _ in range(most_rounds):
        near = pairs.join(labels.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        once = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        jump = once.select(F.col("id").alias("component"), F.col("component").alias("to"))
        new = checkpoint(once.join(jump, "component", "left").select("id", F.least("component", F.coalesce("to", "component")).alias("component"), "was"))
        if not new.filter("component <> was").limit(1).count():
            return new.select("id", "component")
        labels = new.select("id", "component")
    raise RuntimeError("components didn't settle")


def sized_components(labels: DataFrame, least: int = 2) -> DataFrame:
    big = labels.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return labels.join(big, "component")


def largest_component(labels: DataFrame) -> DataFrame:
    """(id) of the largest component, then that with the smallest id."""
    best = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return labels.join(best, "component", "left_semi").select("id")


def reachable_adventures(stages: DataFrame, labels: DataFrame, seeds_: DataFrame) -> DataFrame:
    """(adventure_id, reachable): whether all stages share a component with a seed."""
    good = labels.join(seeds_, "id", "left_semi").select("component").distinct().withColumn("ok", F.lit(True))
    joined = stages.select("adventure_id", "id").join(labels, "id", "left").join(good, "component", "left")
    return joined.groupBy("adventure_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("reachable"))


def trim_loose(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, id) without nodes that have no edge inside their cluster; one pass is the fixpoint, for a removed node has no neighbour to orphan."""
    e = both_ways(edges).select("id", "other")
    inside = members.join(e, "id").join(members.select("cluster", F.col("id").alias("other")), ["cluster", "other"], "left_semi")
    return members.join(inside.select("cluster", "id").distinct(), ["cluster", "id"], "left_semi")


def nearest_crow(points: DataFrame, a: str, b: str):
    return haversine(F.col(f"{a}_lng"), F.col(f"{a}_lat"), F.col(f"{b}_lng"), F.col(f"{b}_lat"))
