"""Aggregations, rankings and set operations over caches, legs and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import lit
from trailspark.functions.planning import suspicious_leg


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the values in order (an aggregate)."""
    s = F.sort_array(F.collect_list(values))
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def kth_smallest(df: DataFrame, column: str, k: int, buckets: int = 1024, few: int = 100_000) -> float | None:
    """The value at place k (from 0) in order, without ordering the whole column: the range that holds it is narrowed by counts per bucket.

    The driver sees one count for each bucket, and at most ``few`` values at the end.
    """
    c = F.col(column).cast("double")
    rows = df.select(c.alias("v")).filter(F.col("v").isNotNull())
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 0 <= k < n:
        return None
    while n > few and high > low:
        width = (high - low) / buckets
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("v") - lit(low)) / lit(width)))
        counts = rows.filter(F.col("v").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        for r in counts:
            if k < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
        if len(counts) == 1:
            break
    if high == low:
        return low
    return rows.filter(F.col("v").between(low, high)).orderBy("v").limit(k + 1).agg(F.max("v")).first()[0]


def freshness(states: DataFrame, bucket: Column, buckets: list[str], kinds: list[str]) -> DataFrame:
    """(kind, bucket, n) with a zero for each pair that has no rows."""
    spark = states.sparkSession
    every = spark.createDataFrame([(k, b) for k in kinds for b in buckets], "kind string, bucket string")
    counted = states.groupBy("kind", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(counted, ["kind", "bucket"], "left").select("kind", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def state_view(caches: DataFrame, states: DataFrame, kinds: tuple[str, ...] = ("walking", "landuse")) -> DataFrame:
    """Every cache with every kind, and its state or ``missing``."""
    each = caches.select("id", "owner").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    s = states.withColumnRenamed("cache_id", "id")
    return each.join(s, ["id", "kind"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def incomplete_pairs(stages: DataFrame, legs: DataFrame) -> DataFrame:
    """Ids of stages of adventures with two stages or more that lack some of their k (k - 1) legs."""
    sizes = stages.groupBy("adventure_id").agg(F.count("*").alias("k")).filter("k >= 2")
    own = stages.select(F.col("id"), "adventure_id")
    a, b = own.select(F.col("id").alias("from_id"), F.col("adventure_id").alias("a")), own.select(F.col("id").alias("to_id"), F.col("adventure_id").alias("b"))
    have = legs.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id").filter("a = b AND from_id <> to_id").groupBy(F.col("a").alias("adventure_id")).agg(F.count("*").alias("n"))
    short = sizes.join(have, "adventure_id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("k") * (F.col("k") - 1))
    return own.join(short.select("adventure_id"), "adventure_id", "left_semi").select("id").distinct()


def upload_stats(rows: DataFrame) -> DataFrame:
    """Counts of an upload: all, by outcome, disabled, archived."""
    n = lambda test, name: F.count_if(test).cast("long").alias(name)
    return rows.groupBy("upload_id").agg(
        F.count("*").cast("long").alias("parsed"), n(F.col("outcome") == "new", "created"), n(F.col("outcome") == "updated", "updated"), n(F.col("outcome") == "stale", "stale"),
        n(F.col("disabled"), "disabled"), n(F.col("archived"), "archived"),
    )


def adventure_completion(stages: DataFrame, included: DataFrame, dropped: DataFrame) -> DataFrame:
    """(adventure_id, name, included, dropped, total, missing): most missing first, then by name."""
    i, d = included.select("id", F.lit(1).alias("i")), dropped.select("id", F.lit(1).alias("d"))
    joined = stages.join(i, "id", "left").join(d, "id", "left")
    out = joined.groupBy("adventure_id").agg(
        F.min("adventure_name").alias("name"), F.count("i").alias("included"), F.count("d").alias("dropped"), F.coalesce(F.max("stage_total").cast("long"), F.count("*")).alias("total")
    )
    return out.filter((F.col("included") > 0) | (F.col("dropped") > 0)).withColumn("missing", F.col("total") - F.col("included")).orderBy(F.desc("missing"), "name")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes, suspicious edges, upper median and greatest length, mean detour ratio.  Edges have meters and straight."""
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select(F.col("to_id").alias("id"))).distinct()
    isolated = nodes.join(ends, "id", "left_anti").agg(F.count("*").alias("isolated"))
    n = nodes.agg(F.count("*").alias("nodes"))
    total = edges.filter("meters IS NOT NULL").count()
    median = edges.sparkSession.createDataFrame([(kth_smallest(edges, "meters", total // 2),)], "median double")
    e = edges.agg(F.count("*").alias("edges"), F.count_if(suspicious_leg(F.col("meters"), F.col("straight"))).alias("suspicious"), F.max("meters").alias("longest"), F.avg(F.when(F.col("straight") > 0, F.col("meters") / F.col("straight"))).alias("detour"))
    return n.crossJoin(e).crossJoin(isolated).crossJoin(median)  # one row each


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, meters) from either end."""
    return edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "meters").union(edges.select(F.col("to_id"), F.col("from_id"), "meters"))


def nearest_walkable(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.min("meters").alias("nearest_m"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"))


def core_distance(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, core): the k-th smallest length at a node, infinite with fewer."""
    order = Window.partitionBy("id").orderBy("meters", "other")
    kth = both_ways(edges).withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("id", F.col("meters").alias("core"))
    return nodes.select("id").join(kth, "id", "left").select("id", F.coalesce("core", lit(float("inf"))).alias("core"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    a, b = core.select(F.col("id").alias("from_id"), F.col("core").alias("ca")), core.select(F.col("id").alias("to_id"), F.col("core").alias("cb"))
    out = edges.join(a, "from_id").join(b, "to_id").select("from_id", "to_id", F.greatest("ca", "cb", "meters").alias("reach"))
    return out.filter(F.col("reach") < float("inf"))


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.count("*").alias("n")
    )


def retrace(path: DataFrame, grid_m: float) -> DataFrame:
    """(tour_id, retrace_m) of points x, y in metres by seq: cells that follow themselves count once, each later visit adds a cell's side."""
    cell = F.struct(F.floor(F.col("x") / lit(grid_m) + 0.5).alias("x"), F.floor(F.col("y") / lit(grid_m) + 0.5).alias("y"))
    order = Window.partitionBy("tour_id").orderBy("seq")
    seen = path.withColumn("cell", cell).withColumn("before", F.lag("cell").over(order)).filter(~F.col("cell").eqNullSafe(F.col("before")))
    visits = seen.groupBy("tour_id", "cell").agg(F.count("*").alias("n"))
    return visits.groupBy("tour_id").agg((F.sum(F.greatest(F.col("n") - 1, F.lit(0))) * lit(grid_m)).alias("retrace_m"))


def backfill_groups(stages: DataFrame) -> DataFrame:
    """(owner, title, n, lng, lat, radius_m): each adventure's mean place, and a radius with a margin around its farthest stage."""
    from trailspark.functions.geo import haversine

    mean = stages.groupBy("owner", "title").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.count("*").alias("n"))
    joined = stages.select("owner", "title", F.col("lng").alias("x"), F.col("lat").alias("y")).join(mean, ["owner", "title"])
    far = joined.groupBy("owner", "title", "lng", "lat", "n").agg(F.max(haversine(F.col("lng"), F.col("lat"), F.col("x"), F.col("y"))).alias("far"))
    return far.select("owner", "title", "n", "lng", "lat", F.greatest(lit(800), F.ceil("far") + lit(600)).alias("radius_m"))


def dedupe_stages(stages: DataFrame) -> DataFrame:
    """One row for each (owner, adventure, stage): a code without a number at its end first, then the smallest id."""
    order = Window.partitionBy("owner", "adventure_id", "stage_sequence").orderBy(F.col("code").rlike("-[0-9]+$"), "id")
    has = F.col("adventure_id").isNotNull() & F.col("stage_sequence").isNotNull()
    kept = stages.filter(has).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return kept.unionByName(stages.filter(~has))


def growth_pool(points: DataFrame, center: tuple[float, float], radius_m: float, pool_m: float, most: int | None = None) -> DataFrame:
    """The pool's points, or the ``most`` of them next to the centre by (distance, id), with a flag for those within the search radius."""
    from trailspark.functions.geo import haversine

    d = haversine(F.col("lng"), F.col("lat"), lit(center[0]), lit(center[1]))
    near = points.withColumn("distance_m", d).filter(F.col("distance_m") <= lit(pool_m))
    return (near if most is None else near.orderBy("distance_m", "id").limit(most)).withColumn("in_radius", F.col("distance_m") <= lit(radius_m))


def thin_seeds(points: DataFrame, tile_m: float, most: int) -> DataFrame:
    """The first point (by id) of each tile, and of those at most ``most`` at an even stride."""
    tile = [F.floor(F.col("lng") * lit(111_320.0) * F.cos(F.radians("lat")) / lit(tile_m)), F.floor(F.col("lat") * lit(111_320.0) / lit(tile_m))]
    first = points.groupBy(*[t.alias(n) for t, n in zip(tile, ("tx", "ty"), strict=True)]).agg(F.min_by(F.struct("id", "lng", "lat"), "id").alias("p")).select("p.*")
    numbered = first.withColumn("r", F.row_number().over(Window.orderBy("id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most)).cast("int"))
    return numbered.filter(F.pmod(F.col("r"), stride) == 0).select("id", "lng", "lat")


def ordered_pairs(members: DataFrame, group: str) -> DataFrame:
    """(from_id, to_id) of all ordered pairs within each (small) group, once."""
    a, b = members.select(group, F.col("id").alias("from_id")), members.select(group, F.col("id").alias("to_id"))
    return a.join(b, group).filter("from_id <> to_id").select("from_id", "to_id").distinct()


def missing_pairs(pairs: DataFrame, legs: DataFrame, version: str) -> DataFrame:
    have = legs.filter(F.col("osrm_version") == version).select("from_id", "to_id")
    return pairs.join(have, ["from_id", "to_id"], "left_anti")


def first_of_lists(base: DataFrame, other: DataFrame) -> DataFrame:
    """Both lists; a row of the base wins over one with its id."""
    return base.unionByName(other.join(base.select("id"), "id", "left_anti"))
