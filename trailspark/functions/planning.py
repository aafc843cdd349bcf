"""Guards, scores and walk arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from trailspark.functions.geo import lit

# Sanity limits of legs.
SLOWEST_MPS, FASTEST_MPS = 0.28, 7.78
MOST_DETOUR, DETOUR_FROM_M = 10.0, 10.0
SUSPICIOUS_WALK_M, SUSPICIOUS_STRAIGHT_M = 5.0, 50.0


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def impossible_speed(meters: Column, seconds: Column) -> Column:
    speed = meters / seconds
    return (
        F.when(~_finite(meters) | ~_finite(seconds), True).when(meters <= 0, False).when(seconds <= 0, True)
        .otherwise((speed < lit(SLOWEST_MPS)) | (speed > lit(FASTEST_MPS)))
    )


def impossible_detour(meters: Column, straight: Column) -> Column:
    return F.when(straight < lit(DETOUR_FROM_M), False).otherwise(meters / straight > lit(MOST_DETOUR))


def suspicious_leg(meters: Column, straight: Column) -> Column:
    return (meters <= lit(SUSPICIOUS_WALK_M)) & (straight >= lit(SUSPICIOUS_STRAIGHT_M))


def entropy(counts: Column, categories: int) -> Column:
    """Shannon entropy of an array of counts, as a share of the most it could be."""
    n = F.aggregate(counts, lit(0), lambda a, c: a + c)
    most = F.least(n, lit(categories))
    h = F.aggregate(counts, lit(0), lambda a, c: a - c / n * F.log(c / n))
    return F.when(most < 2, lit(0)).otherwise(h / F.log(most))


def gaussian(observed: Column, target: float, tolerance: float, weight: float) -> Column:
    z = (observed - lit(target)) / lit(max(tolerance, 1e-6))
    return lit(weight) * F.exp(-z * z)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, lit(1)).otherwise(F.size(F.array_intersect(a, b)) / both)


def visit_minutes(cache_type: Column, needs_tool: Column, by_type: dict[str, float], default: float, lab: float, tool_bonus: float) -> Column:
    known = F.coalesce(*[F.when(cache_type == t, lit(m)) for t, m in by_type.items()], lit(default)) if by_type else lit(default)
    return F.when(cache_type == "Adventure Lab", lit(lab)).otherwise(known) + F.when(needs_tool, lit(tool_bonus)).otherwise(lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(lit(high), F.greatest(lit(low), x))


def walk_pace(kmh: Column, pace_factor: Column, dwell_factor: Column) -> Column:
    profile = kmh / lit(3.6)
    out = profile * clamp(pace_factor, 0.6, 1.5)
    return F.struct((1 / out).alias("out_spm"), (1 / F.least(out, profile)).alias("back_spm"), clamp(dwell_factor, 0.5, 2.0).alias("dwell"))


def prize(cache_type: Column, kinds: Column, preferred_types: list[str], preferred_weight: float, preferred_kinds: list[str], landuse_weight: float) -> Column:
    liked = F.when(cache_type.isin(*preferred_types), lit(preferred_weight)).otherwise(lit(0)) if preferred_types else lit(0)
    wanted = F.array(*[F.lit(k) for k in preferred_kinds]) if preferred_kinds else F.array().cast("array<string>")
    scenic = F.when(F.coalesce(F.arrays_overlap(kinds, wanted), F.lit(False)), lit(landuse_weight)).otherwise(lit(0))
    return lit(1) + liked + scenic


def budget_minutes(duration: Column, buffer: Column) -> Column:
    return F.when(duration.isNotNull(), F.greatest(lit(1), duration - F.coalesce(buffer, lit(0))))


def schedule(key: str, order: str, travel_s: str, visit_s: str) -> tuple[Column, Column]:
    """Seconds after the start at which each stop is reached and left."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    leave = F.sum(F.col(travel_s) + F.col(visit_s)).over(upto)
    return leave - F.col(visit_s), leave


def cluster_id(ids: Column) -> Column:
    """FNV-1a over the four little-endian bytes of each id, as eight hexadecimal digits."""
    mask = F.lit((1 << 32) - 1)

    def step(h: Column, byte: Column) -> Column:
        return (h.bitwiseXOR(byte) * F.lit(16_777_619)).bitwiseAND(mask)

    def four(h: Column, x: Column) -> Column:
        for shift in (0, 8, 16, 24):
            h = step(h, F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(255).cast("long")))
        return h

    h = F.aggregate(ids, F.lit(2_166_136_261).cast("long"), lambda a, x: four(a, x.cast("long")))
    return F.lower(F.lpad(F.hex(h), 8, "0"))
