"""Queries of stateful operators (ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.operators.aggregates import state_view
from trailspark.plans.bindings import entity, load, metres, register
from trailspark.plans.q_aggregates import _VIEW
from trailspark.plans.q_spatial import SQL_LEGS, make_legs
from trailspark.streaming import limiter as L
from trailspark.streaming import precompute as P

C = F.col
#: Event times have no zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts)"


@register("st01_precompute", f"""
    WITH pr AS (SELECT a.id AS from_id, b.id AS to_id, {metres('a', 'b')} AS m FROM caches a JOIN caches b ON a.owner = b.owner AND a.id <> b.id), new AS (SELECT * FROM caches WHERE id % 50 = 0),
    ids AS (SELECT id FROM new UNION SELECT to_id FROM pr WHERE from_id % 50 = 0 AND m <= 1500 UNION SELECT id FROM caches WHERE adventure_id IN (SELECT adventure_id FROM new WHERE adventure_id IS NOT NULL)),
    near AS (SELECT from_id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY m, to_id) AS r FROM pr WHERE m <= 1500 AND from_id IN (SELECT id FROM ids)),
    wanted AS (SELECT from_id, to_id FROM near WHERE r <= 3 UNION SELECT a.id, b.id FROM caches a JOIN caches b ON a.adventure_id = b.adventure_id AND a.id <> b.id WHERE a.id IN (SELECT id FROM ids) AND b.id IN (SELECT id FROM ids))
    SELECT from_id, to_id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM ({SQL_LEGS}) l WHERE l.from_id = w.from_id AND l.to_id = w.to_id AND l.osrm_version = 'v1')""")
def st01(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of one micro-batch: pairs that new caches still need."""
    caches = entity(spark, sf, "caches")
    return P.plan_batch(caches, caches.filter(C("id") % 50 == 0).select("id"), make_legs(caches), "v1", 1500, 3)[1]


_STALE = "state IN ('missing', 'pending', 'failed') OR osrm_version IS DISTINCT FROM 'v1' OR fetched_at IS NULL OR fetched_at < timestamp '1998-01-01' - INTERVAL 365 DAY"


@register("st03_retrigger", f"""
    WITH s AS (SELECT id, owner FROM ({_VIEW}) WHERE kind = 'walking' AND ({_STALE}) ORDER BY id LIMIT 10000), n AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY id) - 1) // 50 AS chunk FROM s)
    SELECT owner, chunk, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM n GROUP BY owner, chunk""")
def st03(spark: SparkSession, sf: str) -> DataFrame:
    view = state_view(entity(spark, sf, "caches"), entity(spark, sf, "states"))
    return P.retrigger(view, "walking", "v1", F.expr("timestamp '1998-01-01'"), 365).withColumn("ids", F.array_join("ids", ","))


@register("st04_backfill", f"""
    WITH s AS (SELECT id, adventure_id FROM caches WHERE adventure_id IS NOT NULL), k AS (SELECT adventure_id, count(*) AS k FROM s GROUP BY 1 HAVING count(*) >= 2),
    h AS (SELECT a.adventure_id, count(*) AS n FROM ({SQL_LEGS}) l JOIN s a ON a.id = l.from_id JOIN s b ON b.id = l.to_id AND a.adventure_id = b.adventure_id WHERE l.osrm_version = 'v1' GROUP BY 1)
    SELECT id FROM ({_VIEW}) WHERE kind = 'walking' AND ({_STALE}) AND id IN (SELECT id FROM s) UNION SELECT id FROM s JOIN k USING (adventure_id) LEFT JOIN h USING (adventure_id) WHERE coalesce(n, 0) < k * (k - 1)""")
def st04(spark: SparkSession, sf: str) -> DataFrame:
    caches = entity(spark, sf, "caches")
    stages = caches.filter("adventure_id IS NOT NULL")  # other legs join no stage
    return P.adventure_backfill(state_view(caches, entity(spark, sf, "states")), stages.select("id", "adventure_id"), make_legs(stages), "v1", F.expr("timestamp '1998-01-01'"), 365)


@register("st05_rate_limit", """
    WITH RECURSIVE e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS key, CAST(epoch(ts) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch(ts), event_id) AS n FROM events),
    w(key, n, t, hits, ends, blocked, allowed) AS (
        SELECT key, n, t, 1, t + 20000, 0e0, true FROM e WHERE n = 1
        UNION ALL SELECT x.key, x.n, x.t, CASE WHEN x.t < w.blocked THEN w.hits WHEN x.t >= w.ends THEN 1 ELSE w.hits + 1 END, CASE WHEN x.t < w.blocked THEN w.ends WHEN x.t >= w.ends THEN x.t + 20000 ELSE w.ends END,
            CASE WHEN x.t < w.blocked THEN w.blocked WHEN x.t >= w.ends THEN 0 WHEN w.hits + 1 > 3 THEN x.t + 5000 ELSE w.blocked END, CASE WHEN x.t < w.blocked THEN false WHEN x.t >= w.ends THEN true ELSE w.hits + 1 <= 3 END
        FROM w JOIN e x ON x.key = w.key AND x.n = w.n + 1)
    SELECT key, count(*) AS n, count(*) FILTER (allowed) AS allowed, CAST(sum(hits) AS BIGINT) AS hits FROM w GROUP BY key""")
def st05(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select((C("user_id") % 40).cast("string").alias("key"), F.expr(MICROS).cast("double").alias("at"), C("event_id").alias("seq")).withColumn("at", C("at") / 1e6)
    return L.replay(e, 20_000, 3, 5000).groupBy("key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.sum("hits").alias("hits"))


@register("st06_login_limit", """
    WITH RECURSIVE e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS key, CAST(epoch(ts) AS DOUBLE) AS t, event_type = 'purchase' AS reset, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch(ts), event_id) AS n FROM events),
    w(key, n, hits, ends) AS (
        SELECT key, n, CASE WHEN reset THEN 0 ELSE 1 END, CASE WHEN reset THEN 0e0 ELSE t + 30000 END FROM e WHERE n = 1
        UNION ALL SELECT x.key, x.n, CASE WHEN x.reset THEN 0 WHEN x.t >= w.ends THEN 1 ELSE w.hits + 1 END, CASE WHEN x.reset THEN 0 WHEN x.t >= w.ends THEN x.t + 30000 ELSE w.ends END FROM w JOIN e x ON x.key = w.key AND x.n = w.n + 1)
    SELECT key, count(*) FILTER (hits <= 4) AS allowed, CAST(sum(hits) AS BIGINT) AS hits FROM w GROUP BY key""")
def st06(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select((C("user_id") % 40).cast("string").alias("key"), (F.expr(MICROS) / F.lit(1e6)).alias("at"), C("event_id").alias("seq"), (C("event_type") == "purchase").alias("reset"))
    return L.login_limit(e, 4, 30_000).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.sum("hits").alias("hits"))


@register("st07_late_guard", "SELECT k, CAST(max(CASE WHEN n = 1 THEN t * 2 + 1 ELSE t * 2 END) AS BIGINT) AS winner FROM (SELECT o_custkey AS k, o_orderkey % 1000 AS t, o_orderkey % 2 AS n FROM orders) GROUP BY k")
def st07(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(C("o_custkey").alias("k"), (C("o_orderkey") % 1000).alias("at"), (C("o_orderkey") % 2).alias("n"))
    best = P.late_guard(o.filter("n = 0"), o.filter("n = 1"), ["k"], "at")
    return best.select("k", (C("at") * 2 + C("n")).alias("winner"))


@register("st08_versions", f"SELECT from_id, to_id FROM ({SQL_LEGS}) WHERE osrm_version = 'v1'")
def st08(spark: SparkSession, sf: str) -> DataFrame:
    return make_legs(entity(spark, sf, "caches")).filter(C("osrm_version") == "v1").select("from_id", "to_id")
