"""Tour plans: the greedy loop, the constrained search, parking, walks, and what surrounds them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import haversine, inside_reach, lit
from trailspark.operators import optimise as O
from trailspark.operators.cluster import Union, colocated
from trailspark.operators.spatial import range_join

# ---- matrices ----------------------------------------------------------------------------------------------------------


def fill_matrix(pairs: DataFrame, cached: DataFrame | dict[str, Column], routed: DataFrame | dict[str, Column], version: str) -> DataFrame:
    """(from_id, to_id, meters, seconds, hit): nothing for itself, cached legs of this version (a noted ``noroute`` stays empty), else routed ones.

    ``cached`` and ``routed`` are tables, or columns over the pairs (null where there is no leg): then each pair has its legs beside it and none is moved.
    """
    if isinstance(cached, DataFrame):
        c = cached.filter(F.col("osrm_version") == version).select("from_id", "to_id", F.col("meters").alias("cm"), F.col("seconds").alias("cs"), F.lit(True).alias("hit"))
        j = pairs.join(c, ["from_id", "to_id"], "left")
    else:
        j = pairs.withColumns({"cm": cached["meters"], "cs": cached["seconds"], "hit": cached["osrm_version"] == version})
    if isinstance(routed, DataFrame):
        j = j.join(routed.select("from_id", "to_id", F.col("meters").alias("rm"), F.col("seconds").alias("rs")), ["from_id", "to_id"], "left")
    else:
        j = j.withColumns({"rm": routed["meters"], "rs": routed["seconds"]})
    same, hit = F.col("from_id") == F.col("to_id"), F.coalesce("hit", F.lit(False))
    two = lambda x: F.floor(x * 100 + 0.5) / lit(100)
    pick = lambda a, b: F.when(same, lit(0)).when(hit, F.col(a)).otherwise(F.col(b))
    return j.select("from_id", "to_id", two(pick("cm", "rm")).alias("meters"), two(pick("cs", "rs")).alias("seconds"), (same | hit).alias("hit"))


# ---- one plan, one task ---------------------------------------------------------------------------------------------------

PLAN = "request long, seq int, id long, kind string, total_m double, reason string"


def plan_loops(stops: DataFrame, matrix: DataFrame, budget_m: float, link_m: float, colocated_m: float = 10.0, search: bool = False, budget_s: float | None = None, visit_s: float = 300.0) -> DataFrame:
    """(request, seq, id, kind, total_m, reason): ordered stops of each request, and those dropped with their reason.

    stops: request, id, out_m and back_m (from and to the start), adventure_id, stage_sequence; matrix: request, from_id, to_id, meters (null where there is no way).
    Steps: gaps closed over links, the largest component kept, stops in one place made one, a short tour, the start put in, the tour trimmed to its
    budgets, places expanded.  ``search`` keeps adventures whole and tries dropped stops again (the solver's part).
    """

    def run(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({c: [] for c in ("request", "seq", "id", "kind", "total_m", "reason")})
        own = own.sort_values("id").reset_index(drop=True)
        ids = own["id"].tolist()
        at = {i: k for k, i in enumerate(ids)}
        m = np.full((len(ids), len(ids)), np.nan)
        for a, b, x in zip(cells["from_id"], cells["to_id"], cells["meters"], strict=True):
            if a in at and b in at and x is not None:
                m[at[a], at[b]] = x
        np.fill_diagonal(m, 0)
        dropped: list[tuple[int, str]] = []
        u = Union(range(len(ids)))
        for i in range(len(ids)):
            for j in range(len(ids)):
                if m[i, j] <= link_m:
                    u.join(i, j)
        parts = sorted(u.groups(), key=lambda g: (-len(g), g[0]))
        keep = set(parts[0])
        dropped += [(ids[i], "unreachable") for g in parts[1:] for i in g]
        d = np.nan_to_num(O.metric_closure(m, link_m), nan=1e9)
        groups = colocated(sorted(keep), lambda a, b: d[a, b], {i: (int(s) if s == s and s is not None else 1 << 30) for i, s in enumerate(own["stage_sequence"])}, colocated_m)
        reps = sorted(groups)
        sub = d[np.ix_(reps, reps)]
        order, _ = O.solve_tour(sub)
        out, back = own["out_m"].to_numpy(float)[reps], own["back_m"].to_numpy(float)[reps]
        order, _ = O.insert_parking(order, out, back, sub)
        again = (lambda o: _resolve(o, sub, out, back)) if search else None
        order, gone = O.trim_to_budget(order, sub, out, back, budget_m, budget_s, visit_s, again=again)
        if search:
            order, gone = _whole_adventures(order, gone, reps, own)
            for k, _ in list(gone):
                best = min((order[:p] + [k] + order[p:] for p in range(len(order) + 1)), key=lambda o: O.closed_length(o, sub, out, back))
                alone = own["adventure_id"].iloc[reps[k]] is None
                if alone and O.closed_length(best, sub, out, back) <= budget_m and (budget_s is None or O.closed_length(best, sub, out, back) / 1.4 + visit_s * len(best) <= budget_s):
                    order, gone = best, [g for g in gone if g[0] != k]
        dropped += [(ids[i], why) for k, why in gone for i in groups[reps[k]]]
        total = O.closed_length(order, sub, out, back)
        flat = [ids[i] for k in order for i in groups[reps[k]]]
        rows = [(n, i, "stop", total, None) for n, i in enumerate(flat)] + [(None, i, "dropped", total, why) for i, why in dropped]
        frame = pd.DataFrame(rows, columns=["seq", "id", "kind", "total_m", "reason"]).assign(request=own["request"].iloc[0])
        return frame.astype({"seq": "Int32"})[["request", "seq", "id", "kind", "total_m", "reason"]]

    return stops.groupBy("request").cogroup(matrix.groupBy("request")).applyInPandas(run, PLAN)


def _resolve(order: list[int], d: np.ndarray, out: np.ndarray, back: np.ndarray) -> list[int]:
    pick = sorted(order)
    tour, _ = O.solve_tour(d[np.ix_(pick, pick)])
    return O.insert_parking([pick[i] for i in tour], out, back, d)[0]


def _whole_adventures(order: list[int], gone: list[tuple[int, str]], reps: list[int], own: pd.DataFrame) -> tuple[list[int], list[tuple[int, str]]]:
    """An adventure that lost a stage goes as a whole."""
    lost = {own["adventure_id"].iloc[reps[k]] for k, _ in gone} - {None}
    out = [k for k in order if own["adventure_id"].iloc[reps[k]] in lost]
    return [k for k in order if k not in out], gone + [(k, "incomplete-adventure") for k in out]


def choose_mode(types: list[str], solver_up: bool, wanted: str = "auto") -> str:
    """The search where there are adventures (or it is asked for) and it can be had, else greedy."""
    search = wanted == "solver" or (wanted == "auto" and "Adventure Lab" in types)
    return "solver" if search and solver_up else "greedy"


def check_constraints(plan: DataFrame, budget_m: float, budget_s: float) -> DataFrame:
    """(request, distance, time, reachable, atomic, contiguous, ordered, dropped, meters): how far each plan breaks the hard constraints, its dropped stops, its length.

    plan: request, seq (null where dropped), id, adventure_id, stage_sequence, sequential, leg_m and leg_s from the stop before (null where there is no way).
    """
    in_ = F.col("seq").isNotNull()
    order = Window.partitionBy("request").orderBy("seq")
    by_adventure = Window.partitionBy("request", "adventure_id").orderBy("seq")
    stops = plan.filter(in_).withColumns({
        "prev": F.lag("adventure_id").over(order), "before": F.max("stage_sequence").over(by_adventure.rowsBetween(Window.unboundedPreceding, -1)),
    })
    starts = F.col("adventure_id").isNotNull() & ~F.col("adventure_id").eqNullSafe(F.col("prev"))
    sums = stops.groupBy("request").agg(
        F.sum(F.coalesce("leg_m", lit(0))).alias("meters"), F.sum(F.coalesce("leg_s", lit(0))).alias("seconds"), F.count_if(F.col("leg_m").isNull()).alias("reachable"),
        (F.count_if(starts) - F.count_distinct("adventure_id")).alias("contiguous"), F.count_if(F.col("sequential") & (F.col("before") > F.col("stage_sequence"))).alias("ordered"),
    )
    whole = plan.filter("adventure_id IS NOT NULL").groupBy("request", "adventure_id").agg(F.count("seq").alias("n"), F.count("*").alias("k"))
    atomic = whole.groupBy("request").agg(F.sum(F.when((F.col("n") > 0) & (F.col("n") < F.col("k")), F.col("k") - F.col("n")).otherwise(0)).alias("atomic"))
    gone = plan.groupBy("request").agg(F.count_if(~in_).alias("dropped"))
    j = gone.join(sums, "request", "left").join(atomic, "request", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select(
        "request", F.greatest(lit(0), F.coalesce("meters", lit(0)) - lit(budget_m)).alias("distance"), F.greatest(lit(0), F.coalesce("seconds", lit(0)) - lit(budget_s)).alias("time"),
        zero("reachable"), zero("atomic"), zero("contiguous"), zero("ordered"), "dropped", F.coalesce("meters", lit(0)).alias("meters"),
    )


# ---- parking -------------------------------------------------------------------------------------------------------------


def own_parking(waypoints: DataFrame) -> DataFrame:
    """(lng, lat) of parking waypoints in order of their ids, one for each five-digit place."""
    place = [F.floor(F.col(c) * 100_000 + 0.5) for c in ("lng", "lat")]
    order = Window.partitionBy(*place).orderBy("id")
    return waypoints.filter(F.col("type") == "parking").withColumn("n", F.row_number().over(order)).filter("n = 1").select("id", "lng", "lat")


def pick_parking(clusters: DataFrame, candidates: DataFrame, link_m: float) -> DataFrame:
    """(cluster, parking_id, meters): the nearest candidate within the link of any member.  clusters: cluster, id, lng, lat.

    Short links come first: a cluster that has a candidate within one needs no longer one.
    """
    out, rest = None, clusters.select("cluster", "id", "lng", "lat")
    for part in (64, 8, 1):
        near = range_join(rest, candidates.select("id", "lng", "lat"), link_m / part)
        best = near.groupBy(F.col("l_cluster").alias("cluster")).agg(F.min_by(F.struct(F.col("r_id").alias("id"), "meters"), F.struct("meters", "r_id")).alias("p"))
        out = best if out is None else out.unionByName(best)
        rest = rest.join(best.select("cluster"), "cluster", "left_anti")
    return out.select("cluster", F.col("p.id").alias("parking_id"), F.col("p.meters").alias("meters"))


def starts(clusters: DataFrame, own: DataFrame, osm: DataFrame, roads: DataFrame, link_m: float) -> DataFrame:
    """(cluster, source, parking_id): own waypoints, then mapped parking, then a road's side, then the centre (without an id)."""
    j = clusters.select("cluster").distinct()
    for name, rows in (("own", own), ("osm", osm), ("road", roads)):
        j = j.join(pick_parking(clusters, rows, link_m).select("cluster", F.col("parking_id").alias(name)), "cluster", "left")
    source = F.when(F.col("own").isNotNull(), "pq").when(F.col("osm").isNotNull(), "osm").when(F.col("road").isNotNull(), "road").otherwise("centroid")
    return j.select("cluster", source.alias("source"), F.coalesce("own", "osm", "road").alias("parking_id"))


def parking_options(parking: DataFrame, caches: DataFrame, legs_factor: float, radius_m: float, most: int = 8) -> DataFrame:
    """(id, cache_id, walk_m, bogus): each parking with its nearest cache, absurd ones last."""
    near = range_join(parking.select("id", "lng", "lat"), caches.select("id", "lng", "lat"), radius_m)
    best = near.groupBy(F.col("l_id").alias("id")).agg(F.min_by(F.struct(F.col("r_id").alias("cache_id"), "meters"), F.struct("meters", "r_id")).alias("b"))
    rows = best.select("id", F.col("b.cache_id").alias("cache_id"), (F.col("b.meters") * lit(legs_factor)).alias("walk_m"), (F.col("b.meters") < lit(1)).alias("bogus"))
    return rows.orderBy("bogus", "walk_m", "id").limit(most)


# ---- legs and loops ------------------------------------------------------------------------------------------------------


def _scored(ways: DataFrame, walked: DataFrame, grid_m: float, alpha: float) -> DataFrame:
    """The ways (leg, alternative, meters, points) with at least two points, with n_points, hits (points in walked cells) and cost: their metres and those that were walked before."""
    cell = lambda c: F.floor(c / lit(grid_m) + lit(0.5))
    points = ways.select("leg", "alternative", F.explode("points").alias("p")).select("leg", "alternative", cell(F.col("p.x")).alias("x"), cell(F.col("p.y")).alias("y"))
    hits = points.join(walked.select("x", "y").distinct(), ["x", "y"], "left_semi").groupBy("leg", "alternative").agg(F.count("*").alias("hits"))
    j = ways.select("leg", "alternative", "meters", F.size("points").alias("n_points")).filter("n_points >= 2").join(hits, ["leg", "alternative"], "left")
    j = j.withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.withColumn("cost", F.col("meters") + lit(alpha) * F.col("hits") * F.col("meters") / (F.col("n_points") - 1))


def pick_legs(alternatives: DataFrame, walked: DataFrame, grid_m: float, alpha: float = 1.0, most_detour: float = 0.5) -> DataFrame:
    """(leg, alternative, cost, meters, n_points, hits, primary_m): of each leg's ways the one with the least cost, the first of equal ones.

    The way with the smallest number is the router's own; others longer than it by more than a share are out.  alternatives: leg, alternative, meters, points
    (array of x, y in metres); walked: x, y cells.
    """
    primary = alternatives.groupBy("leg").agg(F.min_by("meters", "alternative").alias("primary_m"))
    j = _scored(alternatives, walked, grid_m, alpha).join(primary, "leg").filter(F.col("meters") <= F.col("primary_m") * lit(1 + most_detour))
    names = ("alternative", "cost", "meters", "n_points", "hits", "primary_m")
    return j.groupBy("leg").agg(F.min_by(F.struct(*names), F.struct("cost", "alternative")).alias("b")).select("leg", *(F.col(f"b.{c}") for c in names))


def nudge_legs(
    picked: DataFrame, vias: DataFrame, walked: DataFrame, grid_m: float, alpha: float = 1.0, most_detour: float = 0.5,
    overlap_from: float = 0.3, severe_from: float = 0.5, severe_detour: float = 1.5, least_m: float = 150.0,
) -> DataFrame:
    """(leg, source, alternative, cost): picked legs, or a way through a point beside them where that costs less.

    Only legs of some length that share much with walked cells are nudged; where they share most, longer detours are allowed.  vias: leg, alternative, meters, points.
    """
    share = F.col("hits") / F.col("n_points")
    asked = picked.filter((share >= overlap_from) & (F.col("meters") >= least_m)).select(
        "leg", F.col("cost").alias("picked_cost"), (F.col("primary_m") * (1 + F.when(share >= severe_from, lit(max(most_detour, severe_detour))).otherwise(lit(most_detour)))).alias("most_m")
    )
    j = _scored(vias, walked, grid_m, alpha).join(asked, "leg").filter((F.col("meters") <= F.col("most_m")) & (F.col("cost") < F.col("picked_cost")))
    best = j.groupBy("leg").agg(F.min_by(F.struct("alternative", "cost"), F.struct("cost", "alternative")).alias("v"))
    rows = picked.join(best, "leg", "left")
    return rows.select("leg", F.when(F.col("v").isNull(), "alternative").otherwise("nudge").alias("source"), F.coalesce("v.alternative", "alternative").alias("alternative"), F.coalesce("v.cost", "cost").alias("cost"))


def fringe(legs: DataFrame, grid_m: float, most_m: float = 500.0) -> DataFrame:
    """(stop) whose way in and way out share more than ``most_m``: candidates to be left out.  legs: seq, to_stop, points."""
    cell = lambda c: F.floor(c / lit(grid_m) + lit(0.5))
    cells = F.filter(F.transform("points", lambda p: F.struct(cell(p["x"]).alias("x"), cell(p["y"]).alias("y"))), lambda c: c["x"].isNotNull() & c["y"].isNotNull())
    # a leg's cells stay in its row, so that legs are joined and not cells
    rows = legs.select("seq", "to_stop", cells.alias("cells")).repartition("seq").groupBy("seq", "to_stop").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    back = rows.select((F.col("seq") - 1).alias("seq"), F.col("cells").alias("back"))
    shared = rows.join(back, "seq").groupBy("to_stop").agg(F.sum(F.size(F.array_intersect("cells", "back"))).alias("n")).filter("n > 0")
    return shared.filter(F.col("n") * lit(grid_m) > lit(most_m)).select(F.col("to_stop").alias("stop"))


def expand_places(route: DataFrame) -> DataFrame:
    """(request, seq, id, leg_s): members of one place one after the other; legs inside a place take no metres.  route: request, place, members array, leg_m."""
    rows = route.select("request", "place", "leg_m", F.posexplode("members").alias("k", "id"))
    order = Window.partitionBy("request").orderBy("place", "k")
    return rows.select("request", (F.row_number().over(order) - 1).alias("seq"), "id", F.when(F.col("k") == 0, F.col("leg_m") / lit(1.4)).otherwise(lit(0)).alias("leg_s"))


# ---- sets around a plan --------------------------------------------------------------------------------------------------


def whole_adventures(wanted: DataFrame, caches: DataFrame, most: int = 50) -> DataFrame:
    """(id, adventure_id) of the wanted caches and all stages of their adventures: adventures in order of their wanted stages while the sum stays within ``most``."""
    sizes = caches.filter("adventure_id IS NOT NULL").groupBy("adventure_id").agg(F.count("*").alias("k"))
    w = caches.join(wanted.select("id"), "id", "left_semi").select("id", "adventure_id")
    base = w.filter("adventure_id IS NULL")
    a = w.filter("adventure_id IS NOT NULL").groupBy("adventure_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).join(sizes, "adventure_id")
    upto = F.sum("k").over(Window.orderBy(F.desc("n"), "first").rowsBetween(Window.unboundedPreceding, 0))
    kept = a.withColumn("upto", upto).filter(F.col("upto") <= most).select("adventure_id")
    return base.unionByName(caches.join(kept, "adventure_id", "left_semi").select("id", "adventure_id"))


def with_labs(cluster: DataFrame, labs: DataFrame, extra_m: float = 500.0, most: int = 50) -> DataFrame:
    """(id, meters): stages within the cluster's own radius and a margin around its centre, nearest first; whole list capped by the feature."""
    c = cluster.agg(F.avg("lng").alias("cx"), F.avg("lat").alias("cy"))
    far = cluster.crossJoin(c).agg(F.max(haversine(F.col("cx"), F.col("cy"), F.col("lng"), F.col("lat"))).alias("r"), F.max("cx").alias("cx"), F.max("cy").alias("cy"))  # one row
    d = haversine(F.col("cx"), F.col("cy"), F.col("lng"), F.col("lat"))
    rows = labs.join(cluster.select("id"), "id", "left_anti").crossJoin(far).withColumn("meters", d)  # one row on the right
    return rows.filter(F.col("meters") <= F.col("r") + lit(extra_m)).orderBy("meters", "id").limit(most).select("id", "meters")


def prefetch_pairs(ranked: DataFrame) -> DataFrame:
    """(from_id, to_id) of all ordered pairs of the best clusters' members.  ranked: cluster, cache_ids."""
    a = ranked.select("cluster", F.explode("cache_ids").alias("from_id"))
    b = ranked.select("cluster", F.explode("cache_ids").alias("to_id"))
    return a.join(b, "cluster").filter("from_id <> to_id").select("from_id", "to_id").distinct()


def walk_candidates(caches: DataFrame, prize: Column, start: tuple[float, float], end: tuple[float, float], most_m: float, most: int = 60) -> DataFrame:
    """Caches inside the walk's ellipse, the most worthwhile first."""
    off = haversine(lit(start[0]), lit(start[1]), F.col("lng"), F.col("lat")) + haversine(F.col("lng"), F.col("lat"), lit(end[0]), lit(end[1]))
    rows = caches.filter(inside_reach(F.col("lng"), F.col("lat"), start, end, most_m)).withColumns({"prize": prize, "detour_m": off - haversine(lit(start[0]), lit(start[1]), lit(end[0]), lit(end[1]))})
    return rows.orderBy(F.desc("prize"), "detour_m", "id").limit(most)


def keep_old(old_score: float, new_score: float) -> bool:
    """The old plan stays unless the new one is better by one, and by a tenth."""
    return new_score < old_score + max(1.0, 0.1 * old_score)


def replan(candidates: DataFrame, start: tuple[float, float], end: tuple[float, float], budget_s: float, mps: float, visit_s: float, old: list[int] | None = None) -> DataFrame:
    """(seq, id, score, seconds, kept): the walk over the candidates (id, lng, lat, prize, type; bounded), or the old one where the new isn't worth it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x, y = np.radians(pdf["lng"].to_numpy()), np.radians(pdf["lat"].to_numpy())

        def seconds(lng, lat, lng2, lat2):
            h = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lng2 - lng) / 2) ** 2
            return 2 * 6_371_008.8 * np.arcsin(np.minimum(1, np.sqrt(h))) * 1.3 / mps

        s, e = np.radians(start), np.radians(end)
        m = seconds(x[:, None], y[:, None], x[None], y[None])
        p = O.Problem(pdf["prize"].tolist(), [visit_s] * len(pdf), m, seconds(s[0], s[1], x, y).tolist(), seconds(x, y, e[0], e[1]).tolist(), float(seconds(s[0], s[1], e[0], e[1])), budget_s, pdf["type"].tolist())
        at = {int(i): k for k, i in enumerate(pdf["id"])}
        before = O.repair([at[i] for i in old or [] if i in at], p)
        order = O.solve_orienteering(p, before)
        kept = bool(before) and keep_old(O.path_score(before, p), O.path_score(order, p))
        order = before if kept else order
        return pd.DataFrame({"seq": range(len(order)), "id": pdf["id"].to_numpy()[order], "score": O.path_score(order, p), "seconds": O.path_seconds(order, p), "kept": kept})

    return candidates.withColumn("request", F.lit(0)).groupBy("request").applyInPandas(run, "seq int, id long, score double, seconds double, kept boolean")


def derive_saved(plans: DataFrame, caches: DataFrame, parking: DataFrame) -> DataFrame:
    """(request, cache_ids, start, snapshot): what is stored of a plan; a fallback start isn't.  plans: request, seq, id, parking_id, fallback."""
    j = plans.filter("seq IS NOT NULL").join(caches.select("id", "code", "lng", "lat"), "id")
    by = j.groupBy("request").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda s: s["id"]).alias("cache_ids"), F.sort_array(F.collect_list(F.struct("seq", "id", "code", "lng", "lat"))).alias("snapshot"),
        F.max(F.when(~F.col("fallback"), F.col("parking_id"))).alias("parking_id"),
    )
    p = parking.select(F.col("id").alias("parking_id"), F.struct("lng", "lat").alias("start"))
    return by.join(p, "parking_id", "left").select("request", "cache_ids", "start", "snapshot")


def cross_off(fetched: DataFrame, caches: DataFrame, user: int) -> DataFrame:
    """(cache_id, user_id): owned caches that a fetched list marks as found."""
    found = fetched.filter("found").select("code").distinct()
    return caches.join(found, "code", "left_semi").select(F.col("id").alias("cache_id"), F.lit(user).cast("long").alias("user_id"))


def follow(stops: DataFrame, position: tuple[float, float], visited: list[int], arrive_m: float = 30.0) -> DataFrame:
    """(seq, id, visited, next): stops within reach of the position count as visited; the next is the first that isn't."""
    near = haversine(F.col("lng"), F.col("lat"), lit(position[0]), lit(position[1])) <= lit(arrive_m)
    done = stops.withColumn("visited", near | F.col("id").isin(visited) if visited else near)
    first = F.min(F.when(~F.col("visited"), F.col("seq"))).over(Window.partitionBy(F.lit(1)))
    return done.select("seq", "id", "visited", (F.col("seq") == first).alias("next"))
