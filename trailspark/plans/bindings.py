"""The domain's entities over the driver's tables, as SQL that Spark and DuckDB both read, and the registry of queries.

Coordinates derive from integers, so both engines see the same doubles.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.text import CACHE_TYPES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def point(key: str) -> str:
    return f"5e0 + CAST(({key} * 7919) % 10007 AS DOUBLE) / 5e4 AS lng, 52e0 + CAST(({key} * 104729) % 10009 AS DOUBLE) / 5e4 AS lat"


def choose(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


KINDS = ("forest", "park", "residential", "farmland", "industrial", "meadow", "heath", "scrub", "water", "wetland")

ENTITIES = {
    "caches": f"""
        SELECT id, owner, code, type, name, lng, lat, difficulty, terrain, archived, disabled AND NOT archived AS disabled, solved, stage_count,
               CASE WHEN type = 'Adventure Lab' THEN concat('adv', CAST(owner AS STRING), '-', CASE WHEN id % 24 = 10 THEN 'a' ELSE 'b' END) END AS adventure_id,
               CASE WHEN type = 'Adventure Lab' THEN CAST(id % 5 + 1 AS INT) END AS stage_sequence,
               ts
        FROM (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS owner, concat('GC', CAST(c_custkey AS STRING)) AS code, {choose('c_custkey', CACHE_TYPES)} AS type,
                     c_name AS name, {point('c_custkey')}, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 1e0 + CAST(c_custkey % 9 AS DOUBLE) / 2e0 END AS difficulty,
                     CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 1e0 + CAST(c_custkey * 7 % 9 AS DOUBLE) / 2e0 END AS terrain, c_custkey % 23 = 0 AS archived,
                     c_custkey % 19 = 0 AS disabled, c_custkey % 4 = 0 AS solved, c_custkey % 4 AS stage_count, c_custkey % 1000 AS ts FROM {{customer}}) c""",
    "parking": f"""
        SELECT s_suppkey AS id, {point('s_suppkey')}, CASE s_suppkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'yes' WHEN 2 THEN 'customers' END AS access,
               CASE s_suppkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS fee FROM {{supplier}}""",
    "landuse": f"""
        SELECT p_partkey AS osm_id, {choose('p_partkey', KINDS)} AS kind, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('Area ', CAST(p_partkey AS STRING)) END AS name,
               lng AS west, lat AS south, lng + 1e-3 * CAST(1 + p_partkey % 9 AS DOUBLE) AS east, lat + 1e-3 * CAST(1 + p_partkey % 7 AS DOUBLE) AS north
        FROM (SELECT p_partkey, {point('p_partkey')} FROM {{part}}) p""",
    "places": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS osm_id, n_name AS name, {choose('n_nationkey', ('city', 'town', 'village', 'hamlet', 'suburb'))} AS place, {point('(CAST(n_nationkey AS BIGINT) * 31 + 7)')} FROM {{nation}}""",
    "finds": "SELECT DISTINCT user_id % 500 AS cache_id, event_id % 7 AS user_id FROM {events}",
    "attributes": "SELECT DISTINCT l_orderkey % 1500 AS cache_id, CAST(l_partkey % 70 AS INT) AS attr_id, l_linenumber % 2 = 0 AS positive FROM {lineitem}",
    "waypoints": f"""
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 1500 AS cache_id, {choose('l_linenumber', ('parking', 'stages', 'final', 'trailhead'))} AS type, {point('(l_orderkey * 3 + l_linenumber)')}
        FROM {{lineitem}}""",
    "pairs": f"""
        SELECT id, lng AS lng1, lat AS lat1, 5e0 + CAST((id * 15485863) % 10007 AS DOUBLE) / 5e4 AS lng2, 52e0 + CAST((id * 32452843) % 10009 AS DOUBLE) / 5e4 AS lat2
        FROM (SELECT c_custkey AS id, {point('c_custkey')} FROM {{customer}}) p""",
    # states: a row for most caches and kinds
    "states": """
        SELECT o_custkey AS cache_id, CASE WHEN o_orderkey % 2 = 0 THEN 'walking' ELSE 'landuse' END AS kind,
               max(CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'fresh' END) AS state, max(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('v', CAST(o_orderkey % 2 + 1 AS STRING)) END) AS osrm_version,
               max(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END) AS fetched_at
        FROM {orders} GROUP BY o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'walking' ELSE 'landuse' END""",
}
HAVERSINE = (
    "2e0 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"
)


def metres(a: str, b: str) -> str:
    return HAVERSINE.format(a=a, b=b)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ENTITIES[name]
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="trailspark-"))
    return df.checkpoint()


def oracle(sql: str) -> str:
    """A statement with the entities that it names in front of it."""
    needed = [n for n in ENTITIES if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS ({ENTITIES[n].format(**{t: t for t in TABLES})})" for n in needed]
    # DuckDB parts statements' own WITH from the entities' by a comma
    own = sql.strip()
    if own.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, own[15:]])
    if own.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, own[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + own


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def scalar(name: str, source: str, columns: dict[str, tuple[Column | Callable[[], Column], str]], keys: str = "id") -> None:
    """A query of expressions over an entity or table, with DuckDB's equivalents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = entity(spark, sf_dir, source) if source in ENTITIES else load(spark, sf_dir, source)
        return rows.select(*[k.strip() for k in keys.split(",")], *[(c() if callable(c) else c).alias(n) for n, (c, _) in columns.items()])

    register(name, f"SELECT {keys}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in columns.items()) + f" FROM {source}")(run)


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / F.lit(100.0)


def sql_cents(s: str) -> str:
    return f"floor(({s}) * 100 + 0.5) / 100e0"


def rings_of_box() -> Column:
    """A rectangle's ring from west, south, east, north."""
    corner = lambda x, y: F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))
    return F.array(F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south")))


def polygons(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``spread``: dealt to all cores, where each polygon makes many rows and the file is but one task."""
    areas = entity(spark, sf_dir, "landuse")
    areas = areas.repartition(4 * spark.sparkContext.defaultParallelism, "osm_id") if spread else areas
    return areas.withColumn("rings", rings_of_box())
