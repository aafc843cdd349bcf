"""Exports: tracks and routes as XML text, features as JSON, raw samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import escape_xml

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trailspark" xmlns="http://www.topografix.com/GPX/1/1">'


def _point(tag: str, p: Column) -> Column:
    return F.format_string(f'<{tag} lat="%.6f" lon="%.6f">', p["lat"], p["lng"])


def track(name: Column, stops: Column, line: Column) -> Column:
    """Waypoints of the stops (lng, lat, name), and the line as one segment."""
    wpts = F.array_join(F.transform(stops, lambda p: F.concat(_point("wpt", p), F.lit("<name>"), escape_xml(p["name"]), F.lit("</name></wpt>"))), "\n")
    points = F.array_join(F.transform(line, lambda p: F.concat(_point("trkpt", p), F.lit("</trkpt>"))), "\n")
    return F.concat_ws("\n", F.lit(HEAD), wpts, F.concat(F.lit("<trk><name>"), escape_xml(name), F.lit("</name><trkseg>")), points, F.lit("</trkseg></trk>\n</gpx>"))


def route(name: Column, stops: Column) -> Column:
    """A closed route: the first stop comes again at the end."""
    closed = F.concat(stops, F.slice(stops, 1, 1))
    points = F.array_join(F.transform(closed, lambda p: F.concat(_point("rtept", p), F.lit("<name>"), escape_xml(p["name"]), F.lit("</name></rtept>"))), "\n")
    return F.concat_ws("\n", F.lit(HEAD), F.concat(F.lit("<rte><name>"), escape_xml(name), F.lit("</name>")), points, F.lit("</rte>\n</gpx>"))


def feature(osm_id: Column, kind: Column, rings: Column) -> Column:
    """A polygon as a GeoJSON feature."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lng"], p["lat"])))
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), F.struct(osm_id.alias("id"), kind.alias("kind")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    )


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)
