"""Coordinates: validation with reasons, and great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in km; the box of valid points; the box in which latitude and longitude are taken for swapped.
EARTH_KM = 6371.0
VALID = {"lat": (44.0, 53.0), "lng": (22.0, 41.0)}
SWAPPED = {"lat": (15.0, 43.0), "lng": (43.0, 55.0)}


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance in km; the root is kept at most 1, beyond which the arc sine is not a number."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def number(raw: Column) -> Column:
    """A finite number from text that may have a decimal comma, else null."""
    value = F.expr("try_cast(replace(trim(__raw), ',', '.') as double)") if raw is None else F.replace(F.trim(raw.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def validated(lat: Column, lng: Column) -> Column:
    """struct(reason, latitude, longitude, swapped); reason: ok, missing, malformed, zero or out-of-range."""
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    a, b = number(lat), number(lng)
    within = lambda c, box: (c > box[0]) & (c < box[1])
    swapped = F.coalesce(within(a, SWAPPED["lat"]) & within(b, SWAPPED["lng"]), F.lit(False))
    y, x = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    inside = y.between(*VALID["lat"]) & x.between(*VALID["lng"])
    reason = (
        F.when(blank(lat) & blank(lng), "missing").when(a.isNull() | b.isNull(), "malformed").when((a == 0) & (b == 0), "zero").when(~inside, "out-of-range").otherwise("ok")
    )
    ok = reason == "ok"
    return F.struct(reason.alias("reason"), F.when(ok, y).alias("latitude"), F.when(ok, x).alias("longitude"), (ok & swapped).alias("swapped"))


def location_match(point: Column, center: tuple[float, float], radius_km: float, unknown: str = "exclude") -> Column:
    """struct(matched, reason, distance_km) for a validated point; the policy for unknown places holds for missing ones only."""
    distance = haversine_km(F.lit(center[0]), F.lit(center[1]), point["latitude"], point["longitude"])
    missing = point["reason"] == "missing"
    near = distance <= radius_km
    reason = (
        F.when(missing & F.lit(unknown == "include"), "allowed-missing-coordinates")
        .when(missing, "no-coordinates")
        .when(point["reason"] != "ok", "invalid-coordinates")
        .when(near, "within-radius")
        .otherwise("outside-radius")
    )
    return F.struct(reason.isin("allowed-missing-coordinates", "within-radius").alias("matched"), reason.alias("reason"), F.when(point["reason"] == "ok", distance).alias("distance_km"))
