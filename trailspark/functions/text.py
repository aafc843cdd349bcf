"""Text rules of waypoint files, map tags and exports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical types.
CACHE_TYPES = ("Traditional", "Multi", "Mystery", "Letterbox", "EarthCache", "Event", "Virtual", "Webcam", "Wherigo", "CITO", "Adventure Lab", "Other")
WAYPOINT_TYPES = ("parking", "stages", "final", "trailhead", "reference", "question")
# What a raw type starts with, and its canonical type.
TYPE_PREFIXES = (
    ("traditional", "Traditional"),
    ("multi", "Multi"),
    ("unknown", "Mystery"),
    ("mystery", "Mystery"),
    ("puzzle", "Mystery"),
    ("letterbox", "Letterbox"),
    ("earth", "EarthCache"),
    ("event", "Event"),
    ("mega-event", "Event"),
    ("giga-event", "Event"),
    ("virtual", "Virtual"),
    ("webcam", "Webcam"),
    ("wherigo", "Wherigo"),
    ("cito", "CITO"),
    ("lab", "Adventure Lab"),
    ("adventure", "Adventure Lab"),
)
# What a symbol contains, and what a name starts with.
SYMBOL_PARTS = (
    ("parking", "parking"),
    ("trailhead", "trailhead"),
    ("reference", "reference"),
    ("stages", "stages"),
    ("stage of", "stages"),
    ("virtual stage", "stages"),
    ("physical stage", "stages"),
    ("final", "final"),
    ("question", "question"),
)
NAME_PREFIXES = (("PK", "parking"), ("TH", "trailhead"), ("RP", "reference"), ("ST", "stages"), ("FN", "final"), ("QA", "question"))
# Tool hints in descriptions (English, Dutch, German), in catalogue order.
HINTS = (
    ("fishingRod", r"\b(fishing[\s-]*rod|fishing[\s-]*pole|angler|hengel|vishengel|visstok|angelrute|angelhaken|angelschnur)\b"),
    ("binoculars", r"\b(binoculars?|verrekijker|fernglas|ferngl[äa]ser)\b"),
    ("magnet", r"\b(magnet|magnetic|magneet)\b"),
    ("tweezers", r"\b(tweezers|pincet|pinzette)\b"),
    ("ladder", r"\b(ladder|leiter)\b"),
    ("mirror", r"\b(mirror|spiegel)\b"),
)
# Attribute numbers that need a tool.
TOOL_ATTRIBUTES = (3, 4, 5, 11, 12, 44, 48, 49, 50, 51, 64)
MINI_MULTI_STAGES = 2
# Months as file names have them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _first(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(test, F.lit(value)) for test, value in pairs], otherwise)


def cache_type(raw: Column) -> Column:
    head = F.trim(F.split_part(raw, F.lit("|"), F.lit(1)))
    low = F.lower(head)
    rules = [(low.startswith(p), t) for p, t in TYPE_PREFIXES] + [(low == t.lower(), t) for t in CACHE_TYPES]
    return F.when(raw.isNotNull() & (raw != ""), _first(rules, F.lit("Other")))


def waypoint_type(symbol: Column, name: Column) -> Column:
    s, n = F.lower(F.coalesce(symbol, F.lit(""))), F.upper(name)
    return _first([(s.contains(p), t) for p, t in SYMBOL_PARTS] + [(n.startswith(p), t) for p, t in NAME_PREFIXES], F.lit(None).cast("string"))


def parent_code(name: Column) -> Column:
    up = F.upper(name)
    full = F.nullif(F.regexp_extract(up, "GC[A-Z0-9]{1,7}", 0), F.lit(""))
    tail = F.nullif(F.regexp_extract(up, "^[A-Z0-9]{2}([A-Z0-9]{4,7})$", 1), F.lit(""))
    return F.coalesce(full, F.concat(F.lit("GC"), tail), name)


def adventure_id(url: Column) -> Column:
    part = F.nullif(F.regexp_extract(url, r"(?i)labs\.geocaching\.com/goto/([^\s/?#<>\"']+)", 1), F.lit(""))
    guid = F.lower(part).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(guid, F.lower(part)).otherwise(part)


def stage_sequence(url_name: Column) -> Column:
    return F.nullif(F.regexp_extract(url_name, r"(?i)^\s*S(\d+)\b", 1), F.lit("")).cast("int")


def stage_title(name: Column) -> Column:
    """What stands before ``: S<digits>``."""
    return F.trim(F.regexp_replace(name, r": S\d+.*$", ""))


def linear_mark(name: Column, is_adventure: Column) -> tuple[Column, Column]:
    """The name without its ``[L]``, and whether stages come in order (null outside adventures)."""
    marked = name.rlike(r"^\s*\[L\]")
    return F.regexp_replace(name, r"^\s*\[L\]\s*", ""), F.when(is_adventure, marked)


def archived_flag(raw: Column) -> Column:
    return F.coalesce(F.lower(raw) == "true", F.lit(False))


def disabled_flag(raw_available: Column, raw_archived: Column) -> Column:
    available = F.coalesce(F.lower(raw_available) == "true", F.lit(True))
    return ~available & ~archived_flag(raw_archived)


def strip_html(html: Column) -> Column:
    """Tags to spaces, entities to characters with the ampersand last, white space to single spaces."""
    out = F.regexp_replace(html, "<[^<>]*>", " ")
    for pattern, value in (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&amp;", "&")):
        out = F.regexp_replace(out, pattern, value)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def hints(text: Column) -> Column:
    """Keys of the hints in a text, in catalogue order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?iu)" + p), F.lit(k)) for k, p in HINTS]))


def needs_tool(attribute_ids: Column, found_hints: Column) -> Column:
    tools = F.array(*[F.lit(a) for a in TOOL_ATTRIBUTES])
    return F.coalesce(F.arrays_overlap(attribute_ids, tools), F.lit(False)) | (F.coalesce(F.size(found_hints), F.lit(0)) > 0)


def multi_class(stages: Column) -> Column:
    return F.when(stages == 0, "field-puzzle").when(stages <= MINI_MULTI_STAGES, "mini").otherwise("full")


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def kilometres(meters: Column) -> Column:
    """One decimal, none if it is zero."""
    return F.regexp_replace(F.format_string("%.1f", F.floor(meters / 100 + 0.5) / 10), r"\.0$", "")


def place_slug(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+", "")
    return F.regexp_replace(F.substring(s, 1, 24), "-+$", "")


def tour_place(label: Column, parking_name: Column) -> Column:
    return F.nullif(F.substring(F.trim(F.coalesce(label, parking_name)), 1, 60), F.lit(""))


def tour_name(place: Column, meters: Column, caches: Column) -> Column:
    n = F.concat(caches.cast("string"), F.when(caches == 1, " cache").otherwise(" caches"))
    km = kilometres(meters)
    return F.when(place.isNotNull(), F.concat(place, F.lit(" — "), km, F.lit(" km · "), n)).otherwise(F.concat(km, F.lit(" km loop · "), n))


def tour_filename(place: Column, meters: Column, caches: Column, day: Column, mode: str, prefix: str = "tour") -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
    slug = F.nullif(place_slug(place), F.lit(""))
    parts = F.concat_ws("-", slug, F.concat(kilometres(meters), F.lit("km")), F.concat(caches.cast("string"), F.lit("c")), F.concat(month, F.lpad(F.dayofmonth(day).cast("string"), 2, "0")), F.lit(mode))
    return F.concat(F.lit(f"{prefix}-"), parts, F.lit(".gpx"))


def collapse_label(low: Column, high: Column, n: Column) -> Column:
    """``3–5`` for a run of distinct numbers, else ``×3``."""
    return F.when(high - low + 1 == n, F.when(n == 1, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))).otherwise(
        F.concat(F.lit("×"), n.cast("string"))
    )


def share_slug(raw: Column) -> Column:
    """Ten bytes in base 32, lower case, from a hash of what is given."""
    alphabet = "abcdefghijklmnopqrstuvwxyz234567"
    bits = F.lpad(F.conv(F.substring(F.sha2(raw, 256), 1, 10), 16, 2), 40, "0")
    more = F.lpad(F.conv(F.substring(F.sha2(raw, 256), 11, 10), 16, 2), 40, "0")
    both = F.concat(bits, more)
    return F.concat(*[F.substring(F.lit(alphabet), F.conv(F.substring(both, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(16)])


# ---- map tags --------------------------------------------------------------------------------------------------------

# Tags of land use and what they become, in order of precedence; road classes, settlements, speed words in km/h.
LANDUSE_TAGS = ("forest", "park", "residential", "farmland", "industrial", "meadow", "heath", "scrub")
NATURAL_TAGS = {"wood": "forest", "water": "water", "wetland": "wetland", "heath": "heath", "scrub": "scrub"}
LEISURE_TAGS = {"park": "park", "nature_reserve": "park"}
ROAD_CLASSES = ("residential", "living_street", "unclassified", "service", "tertiary")
PLACE_KINDS = ("city", "town", "village", "hamlet", "suburb")
SPEED_WORDS = {"none": 999, "walk": 5, "NL:urban": 50, "NL:rural": 80, "NL:motorway": 100, "NL:zone30": 30}


def landuse_kind(tags: Column) -> Column:
    rules = [(tags["landuse"] == k, k) for k in LANDUSE_TAGS]
    rules += [(tags["natural"] == k, v) for k, v in NATURAL_TAGS.items()] + [(tags["leisure"] == k, v) for k, v in LEISURE_TAGS.items()]
    return _first(rules, F.lit(None).cast("string"))


def first_integer(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).cast("int")


def capacity(s: Column) -> Column:
    return F.coalesce(F.floor(s.try_cast("double")).cast("int"), first_integer(s))


def parking_fee(condition: Column, fee: Column) -> Column:
    return F.when(condition.isin("disc", "free"), "no").when(condition.isin("ticket", "fee"), "yes").otherwise(fee)


def max_speed(s: Column) -> Column:
    n = first_integer(s)
    rules = F.coalesce(*[F.when(s == w, F.lit(v)) for w, v in SPEED_WORDS.items()])
    return F.coalesce(rules, F.when(s.contains("mph"), F.floor(n * F.lit(1.609)).cast("int")).otherwise(n))


def road_class(highway: Column) -> Column:
    return F.when(highway.isin(*ROAD_CLASSES), highway)
