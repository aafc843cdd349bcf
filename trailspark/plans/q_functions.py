"""Queries of the scalar functions (FN), with DuckDB's own expressions beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import geo as G
from trailspark.functions import planning as P
from trailspark.functions import text as T
from trailspark.plans.bindings import cents, entity, load, register, scalar, sql_cents

C = F.col
ENDS = ("lng1", "lat1", "lng2", "lat2")


def _pair(f):
    return lambda: cents(f(*[C(c) for c in ENDS]))


_H = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)"
_HAV = f"2 * 6371008.8e0 * asin(least(1e0, sqrt({_H})))"

scalar("fn01_haversine", "pairs", {"meters": (_pair(G.haversine), sql_cents(_HAV))})
scalar("fn02_haversine_planner", "pairs", {"meters": (_pair(G.haversine_planner), sql_cents(f"2 * 6371000e0 * atan2(sqrt({_H}), sqrt(1 - ({_H})))"))})
_LAT_M = "(111132.92e0 - 559.82e0 * cos(2 * radians({0})) + 1.175e0 * cos(4 * radians({0})))"
_LNG_M = "(111412.84e0 * cos(radians({0})) - 93.5e0 * cos(3 * radians({0})) + 0.118e0 * cos(5 * radians({0})))"
scalar("fn03_degree_metres", "pairs", {
    "lat_m": (lambda: cents(G.degree_lat_m(C("lat1"))), sql_cents(_LAT_M.format("lat1"))), "lng_m": (lambda: cents(G.degree_lng_m(C("lat1"))), sql_cents(_LNG_M.format("lat1"))),
})
scalar("fn04_planar", "pairs", {
    "meters": (lambda: cents(G.planar_distance(*[C(c) for c in ENDS], 5.1, 52.1)), sql_cents(f"sqrt(pow((lng2 - lng1) * {_LNG_M.format('52.1e0')}, 2) + pow((lat2 - lat1) * {_LAT_M.format('52.1e0')}, 2))")),
})
scalar("fn05_equirectangular", "pairs", {
    "x": (lambda: cents(G.equirectangular(C("lng1"), C("lat1"), 5.1, 52.1)[0]), sql_cents("(lng1 - 5.1e0) * 111320e0 * cos(radians(52.1e0))")),
    "y": (lambda: cents(G.equirectangular(C("lng1"), C("lat1"), 5.1, 52.1)[1]), sql_cents("(lat1 - 52.1e0) * 111320e0")),
})
_MOVED = "sqrt(pow(radians(lng2 - lng1) * cos(radians((lat1 + lat2) / 2)), 2) + pow(radians(lat2 - lat1), 2)) * 6371000e0"
scalar("fn06_moved", "pairs", {"meters": (_pair(G.moved_m), sql_cents(_MOVED)), "relocated": (lambda: G.relocated(*[C(c) for c in ENDS]), f"({_MOVED}) > 1")})
scalar("fn07_viewport", "pairs", {
    "west": (lambda: F.floor(G.viewport(C("lng1"), C("lat1"), C("id") * 10)["west"] * 1e6 + 0.5) / F.lit(1e6), "floor((lng1 - degrees(id * 10 * 1.2e0 / (6378137e0 * cos(radians(lat1))))) * 1e6 + 0.5) / 1e6"),
    "north": (lambda: F.floor(G.viewport(C("lng1"), C("lat1"), C("id") * 10)["north"] * 1e6 + 0.5) / F.lit(1e6), "floor((lat1 + degrees(id * 10 * 1.2e0 / 6378137e0)) * 1e6 + 0.5) / 1e6"),
})
scalar("fn08_growth", "pairs", {
    "margin": (lambda: G.growth_margin((C("id") - 100).cast("double")), "CASE WHEN id - 100 <= 0 THEN 0e0 ELSE floor(CAST(id - 100 AS DOUBLE) / 2) END"),
    "pool": (lambda: G.pool_radius(F.lit(1000.0), C("id").cast("double")), "1000e0 + CASE WHEN id <= 0 THEN 0e0 ELSE floor(CAST(id AS DOUBLE) / 2) END"),
})

_RAW_TYPES = ("Traditional Cache|x", " Multi-cache", "Unknown Cache", "mystery", "Puzzle box", "Letterbox Hybrid", "Earthcache", "Mega-Event Cache", "CITO event", "Lab Cache", "other", "Webcam Cache", "Locationless", "")


def _raw(values: tuple[str, ...]) -> str:
    return f"CASE id % {len(values)} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


def _case(tests: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{v}'" for t, v in tests) + f" ELSE {otherwise} END"


def raw(values: tuple[str, ...]):
    return F.expr(_raw(values))


_HEAD = f"lower(trim(split_part({_raw(_RAW_TYPES)}, '|', 1)))"
scalar("fn09_cache_type", "pairs", {
    "type": (lambda: T.cache_type(raw(_RAW_TYPES)), f"CASE WHEN {_raw(_RAW_TYPES)} = '' THEN NULL ELSE " + _case([(f"starts_with({_HEAD}, '{p}')", t) for p, t in T.TYPE_PREFIXES] + [(f"{_HEAD} = '{t.lower()}'", t) for t in T.CACHE_TYPES], "'Other'") + " END"),
})
_SYMBOLS = ("Parking Area", "Trailhead", "Reference Point", "Stages of a Multicache", "Physical Stage", "Final Location", "Question to Answer", "", "Other")
_NAMES = ("PK278XH", "pa12345", "FN GC12ABC", "QA1", "STX", "018ZQ1F", "thing")
scalar("fn10_waypoint_type", "pairs", {
    "type": (lambda: T.waypoint_type(raw(_SYMBOLS), raw(_NAMES)), _case([(f"contains(lower({_raw(_SYMBOLS)}), '{p}')", t) for p, t in T.SYMBOL_PARTS] + [(f"left(upper({_raw(_NAMES)}), 2) = '{p}'", t) for p, t in T.NAME_PREFIXES])),
})
_U = f"upper({_raw(_NAMES)})"
scalar("fn11_parent_code", "pairs", {
    "code": (lambda: T.parent_code(raw(_NAMES)), f"CASE WHEN regexp_matches({_U}, 'GC[A-Z0-9]') THEN regexp_extract({_U}, 'GC[A-Z0-9]{{1,7}}') WHEN regexp_full_match({_U}, '[A-Z0-9]{{2}}[A-Z0-9]{{4,7}}') THEN concat('GC', substr({_U}, 3)) ELSE {_raw(_NAMES)} END"),
})
_URLS = ("https://labs.geocaching.com/goto/MooiePlek", "https://labs.geocaching.com/goto/0F5C1A2B-1111-2222-3333-444455556666?x=1", "https://example.com/a", "")
_SEG = f"regexp_extract({_raw(_URLS)}, 'labs\\.geocaching\\.com/goto/([^\\s/?#]+)', 1)"
scalar("fn12_adventure_id", "pairs", {
    "adventure": (lambda: T.adventure_id(raw(_URLS)), f"CASE WHEN {_SEG} = '' THEN NULL WHEN length({_SEG}) = 36 AND contains({_SEG}, '-') THEN lower({_SEG}) ELSE {_SEG} END"),
})
_STAGES = ("S1 Walk", " s12: Old town", "Castle: S3 Gate", "Summer", "S4x")
scalar("fn13_stage", "pairs", {
    "sequence": (lambda: T.stage_sequence(raw(_STAGES)), "CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 END"),
    "title": (lambda: T.stage_title(raw(_STAGES)), _case([("id % 5 = 0", "S1 Walk"), ("id % 5 = 1", "s12: Old town"), ("id % 5 = 2", "Castle"), ("id % 5 = 3", "Summer")], "'S4x'")),
})
_MARKS = ("[L] Harbour", "Harbour", "  [L]Gate")
scalar("fn14_linear_mark", "pairs", {
    "name": (lambda: T.linear_mark(raw(_MARKS), C("id") % 2 == 0)[0], "CASE id % 3 WHEN 2 THEN 'Gate' ELSE 'Harbour' END"),
    "in_order": (lambda: T.linear_mark(raw(_MARKS), C("id") % 2 == 0)[1], "CASE WHEN id % 2 = 0 THEN id % 3 <> 1 END"),
})
_FLAGS = ("True", "false", "TRUE")
scalar("fn15_flags", "pairs", {
    "archived": (lambda: T.archived_flag(raw(_FLAGS)), "id % 3 <> 1"),
    "disabled": (lambda: T.disabled_flag(F.expr("CASE WHEN id % 4 < 2 THEN 'false' WHEN id % 4 = 2 THEN 'True' END"), raw(_FLAGS)), "id % 4 < 2 AND id % 3 = 1"),
})
_STRIP = "regexp_replace({}, '<[^<>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&amp;", "&")):
    _STRIP = f"regexp_replace({_STRIP}, '{_a}', '{_b}', 'gi')"
scalar("fn16_strip_html", "pages", {"plain": (lambda: T.strip_html(C("html")), f"trim(regexp_replace({_STRIP.format('html')}, '\\s+', ' ', 'g'))")}, keys="page_id")
_HINT_WORDS = ("bring a fishing-rod", "Verrekijker mee", "FERNGLÄSER", "a magnetic thing and a Ladder", "Pinzette", "Spiegel", "nothing", "Leiter, Magneet, angler")
_HINT_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_raw(_HINT_WORDS)}, '(?i)" + p + f"') THEN '{k}' END" for k, p in T.HINTS) + "], lambda x: x IS NOT NULL)"
scalar("fn17_hints", "pairs", {"hints": (lambda: F.array_join(T.hints(raw(_HINT_WORDS)), ","), f"array_to_string({_HINT_SQL}, ',')")})
scalar("fn18_needs_tool", "pairs", {
    "tool": (lambda: T.needs_tool(F.array((C("id") % 70).cast("int"), (C("id") % 11).cast("int")), T.hints(raw(_HINT_WORDS))), f"list_has_any([id % 70, id % 11], [{', '.join(map(str, T.TOOL_ATTRIBUTES))}]) OR id % 8 <> 6"),
})
scalar("fn19_multi_class", "caches", {"multi": (lambda: T.multi_class(C("stage_count")), "CASE WHEN stage_count = 0 THEN 'field-puzzle' WHEN stage_count <= 2 THEN 'mini' ELSE 'full' END")})
scalar("fn20_visit_minutes", "caches", {
    "minutes": (lambda: P.visit_minutes(C("type"), C("id") % 5 == 0, {"Multi": 20.0, "Mystery": 12.0}, 6.0, 4.0, 3.0), "CASE type WHEN 'Adventure Lab' THEN 4e0 WHEN 'Multi' THEN 20e0 WHEN 'Mystery' THEN 12e0 ELSE 6e0 END + CASE WHEN id % 5 = 0 THEN 3e0 ELSE 0e0 END"),
})

_LU, _NA, _LE = ("forest", "grass", "heath", "", "industrial"), ("wood", "water", "", "scrub"), ("park", "nature_reserve", "")


def _tags():
    return F.create_map(*[x for k, v in (("landuse", _LU), ("natural", _NA), ("leisure", _LE)) for x in (F.lit(k), raw(v))])


scalar("fn21_landuse_kind", "pairs", {
    "kind": (lambda: T.landuse_kind(_tags()), _case([(f"{_raw(_LU)} = '{k}'", k) for k in T.LANDUSE_TAGS] + [(f"{_raw(_NA)} = '{k}'", v) for k, v in T.NATURAL_TAGS.items()] + [(f"{_raw(_LE)} = '{k}'", v) for k, v in T.LEISURE_TAGS.items()])),
})
_CAP, _COND, _SPEED = ("30", "30 cars", "20-30", "many", "12.9"), ("disc", "ticket", "free", "fee", "other"), ("50", "30 mph", "none", "walk", "NL:rural", "fast", "NL:zone30")
scalar("fn22_tag_values", "pairs", {
    "capacity": (lambda: T.capacity(raw(_CAP)), "CASE id % 5 WHEN 0 THEN 30 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 4 THEN 12 END"),
    "fee": (lambda: T.parking_fee(raw(_COND), F.lit("maybe")), "CASE WHEN id % 5 IN (0, 2) THEN 'no' WHEN id % 5 IN (1, 3) THEN 'yes' ELSE 'maybe' END"),
    "speed": (lambda: T.max_speed(raw(_SPEED)), "CASE id % 7 WHEN 0 THEN 50 WHEN 1 THEN CAST(floor(30 * 1.609) AS INTEGER) WHEN 2 THEN 999 WHEN 3 THEN 5 WHEN 4 THEN 80 WHEN 6 THEN 30 END"),
    "population": (lambda: T.first_integer(raw(_CAP)), "CASE id % 5 WHEN 0 THEN 30 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 4 THEN 12 END"),
})
_HIGHWAYS = ("residential", "motorway", "service", "tertiary", "path", "living_street", "unclassified")
scalar("fn23_road_class", "pairs", {"class": (lambda: T.road_class(raw(_HIGHWAYS)), f"CASE WHEN id % 7 IN (1, 4) THEN NULL ELSE {_raw(_HIGHWAYS)} END")})
_SEC = "CAST(id % 50 AS DOUBLE) * 10"
scalar("fn24_impossible_speed", "pairs", {
    "bad": (lambda: P.impossible_speed(F.when(C("id") % 31 == 0, F.lit(None)).otherwise((C("id") % 40 - 2).cast("double") * 20), (C("id") % 50).cast("double") * 10),
            f"CASE WHEN id % 31 = 0 THEN true WHEN id % 40 - 2 <= 0 THEN false WHEN {_SEC} <= 0 THEN true ELSE (id % 40 - 2) * 20 / ({_SEC}) < 0.28 OR (id % 40 - 2) * 20 / ({_SEC}) > 7.78 END"),
})
scalar("fn25_impossible_detour", "pairs", {
    "bad": (lambda: P.impossible_detour((C("id") % 90).cast("double") * 20, (C("id") % 60).cast("double")), "CASE WHEN id % 60 < 10 THEN false ELSE CAST(id % 90 AS DOUBLE) * 20 / (id % 60) > 10 END"),
})
scalar("fn27_gaussian", "caches", {"value": (lambda: cents(P.gaussian(F.coalesce(C("difficulty"), F.lit(3.0)), 2.5, 1.5, 10.0)), sql_cents("10 * exp(-pow((coalesce(difficulty, 3e0) - 2.5e0) / 1.5e0, 2))"))})
scalar("fn28_cluster_id", "pairs", {"cluster": (lambda: P.cluster_id(F.array(C("id"), C("id") * 7, F.lit(3).cast("long"))), """(
    SELECT lower(lpad(to_hex(CAST(list_reduce(list_concat([CAST(2166136261 AS HUGEINT)], list_transform([id & 255, (id >> 8) & 255, (id >> 16) & 255, id >> 24, (id * 7) & 255, ((id * 7) >> 8) & 255, ((id * 7) >> 16) & 255, (id * 7) >> 24, 3, 0, 0, 0], lambda b: CAST(b AS HUGEINT))),
        lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT)), 8, '0')))""")})  # fmt: skip
scalar("fn29_jaccard", "pairs", {
    "alike": (lambda: cents(P.jaccard(F.array_distinct(F.array(C("id") % 3, C("id") % 5, C("id") % 7)), F.array_distinct(F.array(C("id") % 2, C("id") % 5)))),
              sql_cents("len(list_intersect(list_distinct([id % 3, id % 5, id % 7]), list_distinct([id % 2, id % 5]))) / CAST(len(list_distinct([id % 3, id % 5, id % 7, id % 2])) AS DOUBLE)")),
})
_PF, _DF = "0.3e0 + CAST(id % 20 AS DOUBLE) / 10", "0.2e0 + CAST(id % 30 AS DOUBLE) / 10"
_OUT = f"(4.5e0 / 3.6e0 * least(1.5e0, greatest(0.6e0, {_PF})))"
scalar("fn30_walk_pace", "pairs", {
    "out_spm": (lambda: F.floor(P.walk_pace(F.lit(4.5), F.expr(_PF), F.expr(_DF))["out_spm"] * 1e6 + 0.5) / F.lit(1e6), f"floor(1 / {_OUT} * 1e6 + 0.5) / 1e6"),
    "back_spm": (lambda: F.floor(P.walk_pace(F.lit(4.5), F.expr(_PF), F.expr(_DF))["back_spm"] * 1e6 + 0.5) / F.lit(1e6), f"floor(1 / least({_OUT}, 4.5e0 / 3.6e0) * 1e6 + 0.5) / 1e6"),
    "dwell": (lambda: cents(P.walk_pace(F.lit(4.5), F.expr(_PF), F.expr(_DF))["dwell"]), sql_cents(f"least(2e0, greatest(0.5e0, {_DF}))")),
})
_KIND1 = ("forest", "residential", "water")
scalar("fn31_prize", "caches", {
    "prize": (lambda: P.prize(C("type"), F.array(raw(_KIND1)), ["Multi", "EarthCache"], 2.0, ["forest", "heath"], 0.5), "1e0 + CASE WHEN type IN ('Multi', 'EarthCache') THEN 2e0 ELSE 0e0 END + CASE WHEN id % 3 = 0 THEN 0.5e0 ELSE 0e0 END"),
})


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2))))"


scalar("fn32_inside_reach", "caches", {
    "inside": (lambda: G.inside_reach(C("lng"), C("lat"), (5.05, 52.05), (5.12, 52.1), 12_000), f"{_hav('5.05e0', '52.05e0', 'lng', 'lat')} + {_hav('lng', 'lat', '5.12e0', '52.1e0')} <= 12000"),
})


@register("fn33_schedule", """
    SELECT owner, id, arrive, arrive + CAST(id % 7 AS DOUBLE) * 60 AS leave FROM (
        SELECT owner, id, (SELECT sum(CAST(b.id % 11 AS DOUBLE) * 60 + CASE WHEN b.id < a.id THEN CAST(b.id % 7 AS DOUBLE) * 60 ELSE 0 END) FROM caches b WHERE b.owner = a.owner AND b.id <= a.id) AS arrive FROM caches a)""")
def fn33(spark: SparkSession, sf: str) -> DataFrame:
    rows = entity(spark, sf, "caches").select("owner", "id", ((C("id") % 11).cast("double") * 60).alias("t"), ((C("id") % 7).cast("double") * 60).alias("v"))
    arrive, leave = P.schedule("owner", "id", "t", "v")
    return rows.select("owner", "id", arrive.alias("arrive"), leave.alias("leave"))


scalar("fn34_budget_minutes", "pairs", {
    "minutes": (lambda: P.budget_minutes(F.when(C("id") % 4 != 0, (C("id") % 90).cast("double")), (C("id") % 20).cast("double")), "CASE WHEN id % 4 <> 0 THEN greatest(1e0, CAST(id % 90 - id % 20 AS DOUBLE)) END"),
})
_PLACES = ("Wageningen", "Bad Münster am Stein-Ebernburg 12", " -- ", "")
_PL = f"nullif(substr(trim({_raw(_PLACES)}), 1, 60), '')"
_KM = "regexp_replace(printf('%.1f', floor(CAST(id * 37 AS DOUBLE) / 100 + 0.5) / 10), '\\.0$', '')"
_SLUG = f"regexp_replace(substr(regexp_replace(regexp_replace(lower({_PL}), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 1, 24), '-+$', '')"
scalar("fn35_tour_names", "pairs", {
    "name": (lambda: T.tour_name(T.tour_place(raw(_PLACES), F.lit(None).cast("string")), (C("id") * 37).cast("double"), C("id") % 9),
             f"CASE WHEN {_PL} IS NULL THEN concat({_KM}, ' km loop · ', id % 9, CASE WHEN id % 9 = 1 THEN ' cache' ELSE ' caches' END) ELSE concat({_PL}, ' — ', {_KM}, ' km · ', id % 9, CASE WHEN id % 9 = 1 THEN ' cache' ELSE ' caches' END) END"),
    "file": (lambda: T.tour_filename(T.tour_place(raw(_PLACES), F.lit(None).cast("string")), (C("id") * 37).cast("double"), C("id") % 9, F.expr("date_add(date '2024-01-01', CAST(id % 366 AS INT))"), "track"),
             f"concat('tour-', concat_ws('-', nullif({_SLUG}, ''), concat({_KM}, 'km'), concat(id % 9, 'c'), strftime(date '2024-01-01' + CAST(id % 366 AS INTEGER), '%b%d'), 'track'), '.gpx')"),
})
scalar("fn36_collapse_label", "pairs", {
    "label": (lambda: T.collapse_label(C("id") % 5, C("id") % 5 + C("id") % 3, C("id") % 4 + 1), "CASE WHEN id % 3 + 1 = id % 4 + 1 THEN CASE WHEN id % 4 = 0 THEN CAST(id % 5 AS VARCHAR) ELSE concat(id % 5, '–', id % 5 + id % 3) END ELSE concat('×', id % 4 + 1) END"),
})
_XML = ("a & b", "<tag>", 'say "hi"', "it's", "&amp;")
scalar("fn37_escape_xml", "pairs", {"xml": (lambda: T.escape_xml(raw(_XML)), _case([("id % 5 = 0", "a &amp; b"), ("id % 5 = 1", "&lt;tag&gt;"), ("id % 5 = 2", "say &quot;hi&quot;"), ("id % 5 = 3", "it&apos;s")], "'&amp;amp;'"))})


@register("fn38_share_slug")
def fn38(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs from a hash of id and seed: the reference's are random, so only their form can be tested."""
    return entity(spark, sf, "pairs").select("id", T.share_slug(F.concat(F.lit("seed-"), C("id").cast("string"))).alias("slug"))


scalar("fn39_rounding", "pairs", {
    "r2": (lambda: G.round_up((C("id") % 1000 - 500).cast("double") / 8, 2), "floor(CAST(id % 1000 - 500 AS DOUBLE) / 8 * 100e0 + 0.5) / 100e0"),
    "r0": (lambda: G.round_up((C("id") % 1000 - 500).cast("double") / 2, 0), "floor(CAST(id % 1000 - 500 AS DOUBLE) / 2 + 0.5)"),
})
_X, _Y = "((lng2 - lng1) * 111320e0 * cos(radians(lat1)))", "((lat2 - lat1) * 111320e0)"
scalar("fn40_via_candidates", "pairs", {
    "lng": (lambda: F.floor(G.perpendicular_offsets(*[C(c) for c in ENDS], F.lit(150.0), F.lit(0.5))["lng"] * 1e6 + 0.5) / F.lit(1e6), f"floor((lng1 + ({_X} * 0.5 - {_Y} / sqrt({_X} * {_X} + {_Y} * {_Y}) * 150) / (111320e0 * cos(radians(lat1)))) * 1e6 + 0.5) / 1e6"),
    "lat": (lambda: F.floor(G.perpendicular_offsets(*[C(c) for c in ENDS], F.lit(150.0), F.lit(0.5))["lat"] * 1e6 + 0.5) / F.lit(1e6), f"floor((lat1 + ({_Y} * 0.5 + {_X} / sqrt({_X} * {_X} + {_Y} * {_Y}) * 150) / 111320e0) * 1e6 + 0.5) / 1e6"),
})
scalar("fn45_detour", "pairs", {
    "meters": (lambda: cents(G.detour(*[C(c) for c in ENDS], F.lit(5.1), F.lit(52.1))), sql_cents(f"{_hav('lng1', 'lat1', '5.1e0', '52.1e0')} + {_hav('5.1e0', '52.1e0', 'lng2', 'lat2')} - {_HAV}")),
})


@register("fn26_entropy", f"""
    WITH n AS (SELECT owner, type, count(*) AS n FROM caches GROUP BY owner, type), t AS (SELECT owner, sum(n) AS total FROM n GROUP BY owner)
    SELECT n.owner, {sql_cents("CASE WHEN max(total) < 2 THEN 0 ELSE -sum(n / total * ln(n / total)) / ln(least(max(total), 12)) END")} AS entropy FROM n JOIN t USING (owner) GROUP BY n.owner""")
def fn26(spark: SparkSession, sf: str) -> DataFrame:
    counts = entity(spark, sf, "caches").groupBy("owner", "type").agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy("owner").agg(F.collect_list("n").alias("ns")).select("owner", cents(P.entropy(C("ns"), 12)).alias("entropy"))


_WORD = 4294967296


@register("fn42_mulberry", f"""
    WITH a AS (SELECT id, (CAST(id AS HUGEINT) + 1831565813) % {_WORD} AS a FROM pairs), b AS (SELECT id, (xor(a, a >> 15) * (a | 1)) % {_WORD} AS t FROM a),
    c AS (SELECT id, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % {_WORD}) % {_WORD}) AS t FROM b)
    SELECT id, CAST(xor(t, t >> 14) AS DOUBLE) / {_WORD}e0 AS value FROM c""")
def fn42(spark: SparkSession, sf: str) -> DataFrame:
    """The first numbers of generators with different seeds (32-bit arithmetic in one Arrow pass)."""
    import pandas as pd

    from trailspark.operators.cluster import mulberry32

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "value": [mulberry32(int(i))() for i in pdf["id"]]})

    return entity(spark, sf, "pairs").select("id").mapInPandas(run, "id long, value double")


@register("fn44_shared_tour", """SELECT concat('slug', o_orderkey) AS slug, concat('Tour ', o_orderkey) AS name, o_totalprice AS meters, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS parking FROM orders WHERE o_orderkey % 2 = 0""")
def fn44(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.to_json(F.struct(F.struct(C("o_totalprice").alias("meters")).alias("totals"), F.struct(C("o_custkey").alias("id"), (C("o_orderkey") % 3 == 0).alias("fallback")).alias("parking")))
    tours = load(spark, sf, "orders").select(F.concat(F.lit("slug"), C("o_orderkey").cast("string")).alias("slug"), F.concat(F.lit("Tour "), C("o_orderkey").cast("string")).alias("name"), C("o_custkey").alias("owner"), plan.alias("plan"), (C("o_orderkey") % 2 == 0).alias("shared"))
    p = F.from_json("plan", "totals struct<meters:double>, parking struct<id:bigint,fallback:boolean>")
    return tours.filter("shared").withColumn("p", p).select("slug", "name", C("p.totals.meters").alias("meters"), F.when(~C("p.parking.fallback"), C("p.parking.id")).alias("parking"))
