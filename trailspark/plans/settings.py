"""Route profiles: nested settings in which every field has a default, and their planner form."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Filters:
    types: tuple[str, ...] = ()
    difficulty: tuple[float, float] = (1.0, 5.0)
    terrain: tuple[float, float] = (1.0, 5.0)
    solved_only: bool = True
    hide_tools: bool = False

    def __post_init__(self) -> None:
        for low, high in (self.difficulty, self.terrain):
            if not 1 <= low <= high <= 5 or low * 2 % 1 or high * 2 % 1:
                raise ValueError("ratings run from 1 to 5 in halves, the lower one first")


@dataclass(frozen=True)
class Budget:
    distance_m: float = 10_000.0
    duration_min: float | None = None
    buffer_min: float = 0.0


@dataclass(frozen=True)
class Time:
    walking_kmh: float = 4.5
    minutes_per_cache: float = 5.0
    minutes_by_type: dict[str, float] = field(default_factory=dict)
    minutes_per_stage: float = 5.0
    tool_bonus: float = 0.0


@dataclass(frozen=True)
class Objective:
    preferred_types: tuple[str, ...] = ()
    preferred_weight: float = 0.0
    landuse_weight: float = 0.0
    variety_weight: float = 0.0


@dataclass(frozen=True)
class Profile:
    name: str = ""
    owner: int | None = None
    filters: Filters = Filters()
    budget: Budget = Budget()
    time: Time = Time()
    objective: Objective = Objective()


def apply_profile(profile: Profile, state: dict[str, Any]) -> dict[str, Any]:
    """The planner's state with the profile's settings in place of its own."""
    return state | {f.name: asdict(getattr(profile, f.name)) for f in fields(profile) if f.name not in ("name", "owner")}


def profile_of(state: dict[str, Any], name: str, owner: int | None) -> Profile:
    parts = {"filters": Filters, "budget": Budget, "time": Time, "objective": Objective}
    out = Profile(name=name, owner=owner)
    for key, kind in parts.items():
        known = {f.name for f in fields(kind)}
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in state.get(key, {}).items() if k in known}
        out = replace(out, **{key: kind(**own)})
    return out


def ordered_profiles(profiles):
    """System profiles first, then by name; see the README on the order of land-use profiles."""
    from pyspark.sql import functions as F

    return profiles.orderBy(F.col("owner").isNotNull(), F.lower("name"), "id")
