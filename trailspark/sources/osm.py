"""Map layers from tagged objects: (osm_type, osm_id, tags, closed) to land use, places, parking and roads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as T


def landuse(objects: DataFrame) -> DataFrame:
    kind = T.landuse_kind(F.col("tags"))
    return objects.filter(F.col("osm_type").isin("W", "R") & F.col("closed")).select("osm_type", "osm_id", kind.alias("kind"), F.col("tags")["name"].alias("name")).filter("kind IS NOT NULL")


def places(objects: DataFrame) -> DataFrame:
    t = F.col("tags")
    return objects.filter((F.col("osm_type") == "N") & t["place"].isin(*T.PLACE_KINDS) & t["name"].isNotNull()).select(
        "osm_id", t["place"].alias("place"), t["name"].alias("name"), T.first_integer(t["population"]).alias("population")
    )


def parking(objects: DataFrame) -> DataFrame:
    t = F.col("tags")
    return objects.filter((t["amenity"] == "parking") & ((F.col("osm_type") == "N") | F.col("closed"))).select(
        "osm_type", "osm_id", t["access"].alias("access"), T.parking_fee(t["parking:condition"], t["fee"]).alias("fee"), t["parking"].alias("parking_type"), T.capacity(t["capacity"]).alias("capacity"), t["name"].alias("name")
    )


def roads(objects: DataFrame) -> DataFrame:
    t = F.col("tags")
    return objects.filter((F.col("osm_type") == "W") & T.road_class(t["highway"]).isNotNull()).select(
        "osm_id", t["highway"].alias("highway"), t["access"].alias("access"), t["motor_vehicle"].alias("motor_vehicle"), T.max_speed(t["maxspeed"]).alias("maxspeed_kmh"), t["service"].alias("service"), t["name"].alias("name")
    )


def import_meta(previous: DataFrame | None, now, state: str, spark) -> DataFrame:
    """The one row that notes the last import."""
    return spark.createDataFrame([(1, now, state)], "id int, imported_at timestamp, state string")
