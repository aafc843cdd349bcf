"""Cluster scores as aggregates: each term of the breakdown is one expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.geo import lit, planar_distance
from trailspark.functions.planning import entropy, gaussian

PARKING_M = 500.0
COMPACT, CHAIN = 1.4, 2.8  # ratios of tour to tree length


@dataclass
class Wishes:
    budget_m: float
    center: tuple[float, float]
    radius_m: float
    density_weight: float = 1.0
    budget_weight: float = 1.0
    terrain: tuple[float, float, float] | None = None  # target, tolerance, weight
    difficulty: tuple[float, float, float] | None = None
    attribute_weights: dict[int, float] = field(default_factory=dict)
    kinds: list[str] = field(default_factory=list)
    landuse_weight: float = 0.0
    variety_weight: float = 0.0
    types: list[str] = field(default_factory=list)
    type_weight: float = 1.0
    center_weight: float = 0.0


def score_clusters(members: DataFrame, lengths: DataFrame, w: Wishes) -> DataFrame:
    """(cluster, size, breakdown map, total).

    members: cluster, id, lng, lat, type, difficulty, terrain, attribute_ids, kinds, parking_m (metres to the owner's nearest parking waypoint or null);
    lengths: cluster, tree_m, tour_m.
    """
    attribute = F.aggregate("attribute_ids", lit(0), lambda s, a: s + F.coalesce(*[F.when(a == k, lit(v)) for k, v in w.attribute_weights.items()], lit(0)))
    wanted = F.array(*[F.lit(k) for k in w.kinds]).cast("array<string>")
    target = lambda x, t: F.avg(F.coalesce(F.col(x), lit(t[0]))).alias(x)
    types = members.groupBy("cluster", "type").agg(F.count("*").cast("double").alias("n")).groupBy("cluster").agg(F.collect_list("n").alias("types"))
    bands = members.filter("difficulty IS NOT NULL").groupBy("cluster", F.floor(F.col("difficulty") + 0.5)).agg(F.count("*").cast("double").alias("n")).groupBy("cluster").agg(F.collect_list("n").alias("bands"))
    own = members.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.max(F.coalesce(F.col("parking_m") <= lit(PARKING_M), F.lit(False))).alias("parking"),
        target("terrain", w.terrain or (3.0,)), target("difficulty", w.difficulty or (3.0,)), F.avg(attribute).alias("attributes"),
        F.avg(F.when(F.coalesce(F.arrays_overlap("kinds", wanted), F.lit(False)), lit(1)).otherwise(lit(0))).alias("landuse"),
        F.avg(F.when(F.col("type").isin(*w.types) if w.types else F.lit(False), lit(1)).otherwise(lit(0))).alias("liked"),
    )
    c = own.join(lengths, "cluster").join(types, "cluster", "left").join(bands, "cluster", "left")
    tree, tour = F.col("tree_m"), F.when(F.col("tour_m") > 0, F.col("tour_m")).otherwise(F.col("tree_m"))
    off = (tour - lit(w.budget_m)) / lit(w.budget_m)
    terms = {
        "clusterDensity": F.when(tree > 0, F.col("size") * 100 / tree).otherwise(lit(0)) * lit(w.density_weight),
        "parkingPresence": F.col("parking").cast("double"),
        "loopShape": F.when((F.col("tour_m") > 0) & (tree > 0), F.greatest(lit(0), F.least(lit(1), (lit(CHAIN) - F.col("tour_m") / tree) / lit(CHAIN - COMPACT)))).otherwise(lit(0)),
        "budgetFit": F.exp(-off * off) * lit(w.budget_weight),
    }
    if w.terrain:
        terms["terrainMatch"] = gaussian(F.col("terrain"), *w.terrain)
    if w.difficulty:
        terms["difficultyMatch"] = gaussian(F.col("difficulty"), *w.difficulty)
    if w.attribute_weights:
        terms["attrPrefMatch"] = F.col("attributes")
    if w.kinds:
        terms["landuseMatch"] = F.col("landuse") * lit(w.landuse_weight)
    if w.variety_weight > 0:
        terms["variety"] = (entropy(F.col("types"), 12) + F.coalesce(entropy(F.col("bands"), 5), lit(0))) / 2 * lit(w.variety_weight)
    if w.types:
        terms["preferredTypes"] = F.col("liked") * lit(w.type_weight)
    if w.center_weight > 0:
        away = planar_distance(F.col("lng"), F.col("lat"), lit(w.center[0]), lit(w.center[1]), *w.center)
        terms["centerProximity"] = F.greatest(lit(0), 1 - away / lit(max(w.radius_m, 1.0))) * lit(w.center_weight)
    total = sum(list(terms.values())[1:], list(terms.values())[0])
    breakdown = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), v)])
    return c.select("cluster", "size", breakdown.alias("breakdown"), total.alias("total"))


def rank(scored: DataFrame, most: int = 5) -> DataFrame:
    return scored.filter("size >= 2").orderBy(F.desc("total"), "cluster").limit(most)
