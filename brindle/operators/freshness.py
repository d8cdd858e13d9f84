"""Late-data rules: what is new, late, refreshed or old."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freshness(published: Column, refreshed: Column, now: Column, boundary: Column, max_age: Column, grace: Column) -> Column:
    """The kind of a row; the order of the rules is the contract, and both limits count as inside."""
    old = published < now - max_age
    late = boundary.isNotNull() & (published < boundary)
    return (
        F.when(published.isNull(), "first_noticed")
        .when(old & (refreshed >= now - max_age), "refreshed_old")
        .when(old, "old_publication")
        .when(late & (published >= now - grace), "new_publication")
        .when(late, "late_discovered")
        .otherwise("new_publication")
    )


def deliverable(kind: Column, strict: bool) -> Column:
    return (kind == "new_publication") | ((kind == "first_noticed") & F.lit(not strict))


def crossed_boundary(published: Column, watermark: Column, overlap: Column) -> Column:
    return F.coalesce(published <= watermark - overlap, F.lit(False))


def monitoring_boundary(last_success: Column, established: Column, cutover: Column) -> Column:
    """The later of the last complete poll (or the baseline) and the policy's cutover, nulls skipped."""
    return F.greatest(F.coalesce(last_success, established), cutover)


def too_old(published: Column, now: Column, limit: Column | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(now - published > limit, F.lit(False))
