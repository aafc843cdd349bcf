"""Queries of jobs and outer sources that complete the inventory: re-processing, requests to outside services as tables, parameters, samples, retries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.operators import aggregates as A
from trailspark.operators import finder as X
from trailspark.operators import maintenance as M
from trailspark.operators import optimise as O
from trailspark.plans import settings
from trailspark.plans.bindings import cents, entity, load, register, scalar, sql_cents
from trailspark.plans.q_maintenance import _xml
from trailspark.plans.q_planning import _distances, _points
from trailspark.plans.q_spatial import SQL_LEGS, make_legs
from trailspark.sources import gpx
from trailspark.streaming.precompute import late_guard, retained, retry_states

C = F.col


@register("src04_reprocess", "SELECT CASE WHEN id % 9 = 0 THEN 'warning' WHEN id % 4 = 1 THEN 'waypoint' ELSE 'cache' END AS kind, count(*) AS n FROM caches WHERE owner = 3 GROUP BY 1")
def src04(spark: SparkSession, sf: str) -> DataFrame:
    """One stored file, found by its owner and parsed again."""
    stored = _xml(spark, sf).filter(C("owner") == 3)
    return gpx.parse(gpx.parse_strings(stored, "xml")).groupBy("kind").agg(F.count("*").alias("n"))


scalar("src07_area_request", "pairs", {
    "radius_km": (lambda: (F.ceil((C("id") % 9000) / F.lit(1000.0)) + 1).cast("int"), "CAST(ceil((id % 9000) / 1000e0) + 1 AS INTEGER)"), "most": (lambda: F.lit(50), "50"), "linear": (lambda: F.lit("mark"), "'mark'"),
})
_ALT = "SELECT l_orderkey AS leg, l_linenumber AS alternative, l_extendedprice AS meters FROM lineitem"


@register("src08_alternatives", f"SELECT leg, alternative, {sql_cents('meters')} AS meters FROM (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY meters, alternative) AS r FROM ({_ALT})) WHERE r <= 5")
def src08(spark: SparkSession, sf: str) -> DataFrame:
    """The router's alternatives come as a table: at most five for each leg, shortest first."""
    rows = load(spark, sf, "lineitem").select(C("l_orderkey").alias("leg"), C("l_linenumber").alias("alternative"), C("l_extendedprice").alias("meters"))
    r = F.row_number().over(Window.partitionBy("leg").orderBy("meters", "alternative"))
    return rows.withColumn("r", r).filter("r <= 5").select("leg", "alternative", cents(C("meters")).alias("meters"))


@register("src08b_multi", f"SELECT a.from_id, {sql_cents('a.meters + b.meters')} AS meters FROM ({SQL_LEGS}) a JOIN ({SQL_LEGS}) b ON b.from_id = a.to_id AND b.to_id = a.from_id WHERE a.from_id < a.to_id")
def src08b(spark: SparkSession, sf: str) -> DataFrame:
    """A route over several stops is the sum of its legs: there and back again."""
    legs = make_legs(entity(spark, sf, "caches"))
    back = legs.select(C("from_id").alias("to_id"), C("to_id").alias("from_id"), C("meters").alias("back"))
    return legs.filter("from_id < to_id").join(back, ["from_id", "to_id"]).select("from_id", cents(C("meters") + C("back")).alias("meters"))


@register("src10_json_parameters", """
    SELECT id, owner FROM caches WHERE owner < 6 AND EXISTS (SELECT 1 FROM attributes a WHERE a.cache_id = caches.id AND ((attr_id = 10 AND positive) OR (attr_id = 0 AND NOT positive))) AND EXISTS (SELECT 1 FROM attributes a WHERE a.cache_id = caches.id AND attr_id = 30 AND positive)""")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    given = '[[{"id": 10, "positive": true}, {"id": 0, "positive": false}], [{"id": 30, "positive": true}]]'
    groups = [[(a["id"], a["positive"]) for a in g] for g in json.loads(given)]
    rows = entity(spark, sf, "attributes").groupBy(C("cache_id").alias("id")).agg(F.collect_list(F.struct("attr_id", "positive")).alias("attributes"))
    return entity(spark, sf, "caches").filter(C("owner") < 6).join(rows, "id").filter(X.has_attributes(C("attributes"), groups)).select("id", "owner")


@register("snk04_samples", """SELECT CAST(event_id AS BIGINT) AS id, concat('{"phase":"', event_type, '","pass":', event_id % 3, '}') AS line FROM events""")
def snk04(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct(C("event_type").alias("phase"), (C("event_id") % 3).alias("pass")))
    return load(spark, sf, "events").select(C("event_id").alias("id"), line.alias("line"))


@register("fn43_profile_mapping", "SELECT * FROM (VALUES ('budget.distance_m', '8000.0'), ('filters.solved_only', 'False'), ('objective.variety_weight', '0.0'), ('other', 'kept'), ('time.walking_kmh', '5.0')) v(key, value)")
def fn43(spark: SparkSession, sf: str) -> DataFrame:
    p = settings.Profile("p", None, settings.Filters(solved_only=False), settings.Budget(distance_m=8000.0), settings.Time(walking_kmh=5.0))
    state = settings.apply_profile(p, {"other": "kept"})
    rows = [(k, str(state[k.split(".")[0]][k.split(".")[1]])) for k in ("budget.distance_m", "filters.solved_only", "objective.variety_weight", "time.walking_kmh")] + [("other", state["other"])]
    return spark.createDataFrame(rows, "key string, value string")


@register("st02_repeated_batch", "SELECT o_custkey AS k, max(o_orderkey) AS at FROM orders GROUP BY 1")
def st02(spark: SparkSession, sf: str) -> DataFrame:
    """A micro-batch that is delivered twice changes nothing the second time."""
    o = load(spark, sf, "orders").select(C("o_custkey").alias("k"), C("o_orderkey").alias("at"))
    once = late_guard(o.filter(C("at") % 2 == 0), o.filter(C("at") % 2 == 1), ["k"], "at")
    return late_guard(once, o.filter(C("at") % 2 == 1), ["k"], "at")


@register("st09_adventure_job", """
    WITH s AS (SELECT id, owner, code, stage_sequence, CASE WHEN adventure_id IS NULL OR id % 4 = 2 THEN concat('new', owner) ELSE adventure_id END AS adventure_id FROM caches WHERE type IN ('Adventure Lab', 'Other'))
    SELECT min(id) AS id FROM s WHERE stage_sequence IS NOT NULL GROUP BY owner, adventure_id, stage_sequence UNION ALL SELECT id FROM s WHERE stage_sequence IS NULL""")
def st09(spark: SparkSession, sf: str) -> DataFrame:
    """Missing ids are filled from the fetched rows, then stages that doubled are dropped."""
    c = entity(spark, sf, "caches").filter(C("type").isin("Adventure Lab", "Other")).select("id", "owner", "code", "stage_sequence", F.when(C("id") % 4 == 2, F.lit("")).otherwise(C("adventure_id")).alias("adventure_id"))
    known = c.select("code", F.concat(F.lit("new"), C("owner").cast("string")).alias("adventure_id"))
    return A.dedupe_stages(M.set_adventure_if_missing(c, known)).select("id")


@register("src09_solver", """
    WITH n AS (SELECT owner * 1000000 + (row_number() OVER (PARTITION BY owner ORDER BY id) - 1) // 60 AS instance FROM caches), k AS (SELECT instance, count(*) AS n FROM n GROUP BY 1)
    SELECT instance, CASE WHEN instance % 7 = 0 AND n > 2 THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN instance % 7 = 0 AND n > 2 THEN 0 ELSE n END AS stops FROM k""")
def src09(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to the solver; those of every seventh instance lack a distance and fail."""
    m = _distances(_points(spark, sf)).filter(~((C("instance") % 7 == 0) & (C("i") == 1) & (C("j") == 2)))
    return O.solver_plans(m).groupBy("instance", "status").agg(F.count_distinct("stop").alias("stops"))


_ATTEMPTS = 'SELECT o_custkey AS job, CAST(o_orderkey AS DOUBLE) AS "at", o_orderkey % 9 = 0 AS ok FROM orders'


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(C("o_custkey").alias("job"), C("o_orderkey").cast("double").alias("at"), (C("o_orderkey") % 9 == 0).alias("ok"))


@register("st02b_retries", f"""
    SELECT job, CASE WHEN bool_or(ok) THEN 'done' WHEN count(*) >= 12 THEN 'failed' ELSE 'waiting' END AS state, count(*) AS tries, max("at") AS "at",
           CASE WHEN NOT bool_or(ok) AND count(*) < 12 THEN max("at") + 5 * pow(2, count(*) - 1) END AS next_at FROM ({_ATTEMPTS}) GROUP BY job""")
def st02b(spark: SparkSession, sf: str) -> DataFrame:
    return retry_states(_attempts(spark, sf), 12, 5.0)


@register("st02c_retention", f"""
    WITH j AS (SELECT job, CASE WHEN bool_or(ok) THEN 'done' WHEN count(*) >= 12 THEN 'failed' ELSE 'waiting' END AS state, max("at") AS "at" FROM ({_ATTEMPTS}) GROUP BY job)
    (SELECT job, state FROM j WHERE state = 'done' AND "at" >= 11400 ORDER BY "at" DESC, job LIMIT 300) UNION ALL SELECT job, state FROM j WHERE state = 'failed' AND "at" >= 5000 UNION ALL SELECT job, state FROM j WHERE state = 'waiting'""")
def st02c(spark: SparkSession, sf: str) -> DataFrame:
    return retained(retry_states(_attempts(spark, sf), 12, 5.0), 15_000.0, 3600.0, 300, 10_000.0).select("job", "state")
