"""Waypoint XML: reading, parsing, de-duplicated ingest, raw storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import text as T

WPT = (
    "STRUCT<_lat DOUBLE, _lon DOUBLE, name STRING, desc STRING, cmt STRING, sym STRING, type STRING, url STRING, urlname STRING, "
    "`lab2gpx:adventureLab` STRUCT<`lab2gpx:stagesTotal`: INT>, "
    "`groundspeak:cache` STRUCT<_id: BIGINT, _archived: STRING, _available: STRING, `groundspeak:name`: STRING, `groundspeak:type`: STRING, "
    "`groundspeak:container`: STRING, `groundspeak:difficulty`: DOUBLE, `groundspeak:terrain`: DOUBLE, `groundspeak:short_description`: STRING, "
    "`groundspeak:long_description`: STRING, `groundspeak:attributes`: STRUCT<`groundspeak:attribute`: ARRAY<STRUCT<_id: INT, _inc: INT, _VALUE: STRING>>>>>"
)
WPT_SCHEMA = WPT.removeprefix("STRUCT<").removesuffix(">")


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "wpt").schema(WPT_SCHEMA).load(path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(exported_at, is_my_finds) of each file: its time, and whether its name says that it lists the user's finds."""
    raw = spark.read.format("xml").option("rowTag", "gpx").schema("name STRING, time STRING").load(path)
    return raw.select(timestamp(F.col("time")).alias("exported_at"), F.coalesce(F.col("name").rlike("(?i)my finds"), F.lit(False)).alias("is_my_finds"))


def timestamp(raw: Column) -> Column:
    """A moment, or null where the text isn't one."""
    return F.try_to_timestamp(F.trim(raw))


def parse(waypoints: DataFrame) -> DataFrame:
    """Each waypoint with ``kind`` (cache, waypoint, warning) and the fields of its kind."""
    gs = F.col("groundspeak:cache")
    placed = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    is_cache = gs.isNotNull() & (F.coalesce(F.trim("name"), F.lit("")) != "")
    wtype = T.waypoint_type(F.col("sym"), F.coalesce("name", F.lit("")))
    kind = F.when(~placed, "warning").when(is_cache, "cache").when(gs.isNull() & wtype.isNotNull(), "waypoint").otherwise("warning")
    ctype = T.cache_type(gs["groundspeak:type"])
    is_lab = ctype == "Adventure Lab"
    title, in_order = T.linear_mark(F.coalesce(gs["groundspeak:name"], F.col("urlname")), is_lab)
    description = T.strip_html(F.concat_ws(" ", gs["groundspeak:short_description"], gs["groundspeak:long_description"]))
    attributes = F.transform(gs["groundspeak:attributes"]["groundspeak:attribute"], lambda a: F.struct(a["_id"].alias("attr_id"), (a["_inc"] == 1).alias("positive")))
    return waypoints.select(
        kind.alias("kind"), F.trim("name").alias("code"), F.col("_lon").alias("lng"), F.col("_lat").alias("lat"), ctype.alias("type"), title.alias("name"),
        F.when(is_lab, in_order).alias("adventure_sequential"), gs["groundspeak:container"].alias("size"), gs["groundspeak:difficulty"].alias("difficulty"),
        gs["groundspeak:terrain"].alias("terrain"), T.archived_flag(gs["_archived"]).alias("archived"), T.disabled_flag(gs["_available"], gs["_archived"]).alias("disabled"),
        T.hints(description).alias("description_hints"), F.coalesce(attributes, F.array().cast("array<struct<attr_id:int,positive:boolean>>")).alias("attributes"),
        T.adventure_id(F.col("url")).alias("adventure_id"), T.stage_sequence(F.col("urlname")).alias("stage_sequence"), F.col("lab2gpx:adventureLab")["lab2gpx:stagesTotal"].alias("stage_total"),
        (F.lower("sym").contains("found")).alias("found"), wtype.alias("waypoint_type"), T.parent_code(F.coalesce("name", F.lit(""))).alias("parent_code"), F.coalesce("cmt", "desc").alias("note"),
    )


def parse_strings(documents: DataFrame, column: str) -> DataFrame:
    """One row for each ``<wpt>`` element of XML strings: the same rules where files come as rows."""
    one = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<wpt\b.*?</wpt>"), F.lit(0))).alias("x")
    others = [c for c in documents.columns if c != column]
    rows = documents.select(*others, one).withColumn("w", F.from_xml("x", WPT_SCHEMA, {"rowTag": "wpt"}))
    return rows.select(*others, "w.*")


def store_raw(uploads: DataFrame, path: str) -> None:
    """(owner, upload_id, xml) as compressed text by owner; read back by ``read_raw``."""
    uploads.select("owner", F.to_json(F.struct("upload_id", "xml")).alias("value")).write.partitionBy("owner").option("compression", "gzip").mode("append").text(path)


def read_raw(spark: SparkSession, path: str, upload_id: str) -> DataFrame:
    rows = spark.read.text(path).select("owner", F.from_json("value", "upload_id string, xml string").alias("r")).select("owner", "r.*")
    return rows.filter(F.col("upload_id") == upload_id)


def with_hash(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("sha", F.sha2(F.col("xml").cast("binary"), 256))


def ingest_for_token(uploads: DataFrame, tokens: DataFrame) -> DataFrame:
    """Uploads by machine: (token, xml) become their owner's; unknown tokens go."""
    return uploads.join(tokens.select("token", "owner"), "token").drop("token")
