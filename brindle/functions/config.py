"""Settings from the environment: tolerant booleans, integers with bounds, lists of allowed values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

#: The default centre and radius, and what each setting may be.
KINDS = ("apartment", "house")
POLICIES = ("exclude", "include")


def as_bool(raw: str | None, default: bool) -> bool:
    return default if raw is None or not raw.strip() else raw.strip().lower() in ("1", "true", "yes", "on")


def as_int(raw: str | None, default: int, least: int, most: int) -> int:
    """Text that is no integer counts as the default; others are kept within the bounds."""
    try:
        return min(most, max(least, int((raw or "").strip())))
    except ValueError:
        return default


def as_list(raw: str | None, allowed: tuple[str, ...]) -> tuple[str, ...]:
    """The allowed values named in a comma-separated list, in the order of `allowed`; all if it names none."""
    named = {x.strip().lower() for x in (raw or "").split(",")}
    return tuple(x for x in allowed if x in named) or allowed


@dataclass(frozen=True)
class Settings:
    center_lat: float = 49.8397
    center_lng: float = 24.0297
    radius_km: int = 15
    unknown_places: str = "exclude"
    kinds: tuple[str, ...] = KINDS
    max_age_days: int = 7
    grace_minutes: int = 60
    dry_run: bool = False

    @classmethod
    def of(cls, env: Mapping[str, str], prefix: str = "LISTINGS_") -> Settings:
        get = lambda name: env.get(prefix + name.upper())
        base = cls()
        found = {
            "radius_km": as_int(get("radius_km"), base.radius_km, 1, 500),
            "unknown_places": get("unknown_places") if get("unknown_places") in POLICIES else base.unknown_places,
            "kinds": as_list(get("kinds"), KINDS),
            "max_age_days": as_int(get("max_age_days"), base.max_age_days, 0, 3650),
            "grace_minutes": as_int(get("grace_minutes"), base.grace_minutes, 0, 10_000),
            "dry_run": as_bool(get("dry_run"), base.dry_run),
        }
        return cls(**{f.name: found.get(f.name, getattr(base, f.name)) for f in fields(cls)})
