"""Coverage by full scans: what is committed, how old the last whole snapshot is, and why coverage is not proven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.walks import running

#: A full scan is due after `DUE` minutes, unsafe after `UNSAFE`; page cap of a scan, and reasons that coverage is not proven, in this order.
DUE, UNSAFE, PAGE_CAP = 30, 60, 25
BLOCKS = ["apartments_end_unknown", "apartments_hit_page_cap_still_novel", "apartments_last_page_still_had_novel_ids", "houses_end_unknown", "elapsed_exceeds_olx_total_budget", "elapsed_exceeds_half_poll_cycle", "projected_nav_time_exceeds_olx_total_budget"]
# End of the fixed values.


def cycles(scans: DataFrame, group: str) -> DataFrame:
    """One row a cycle of `group` with its scans put together: (group, cycle, at, whole, full, troubled).

    `scans`: group, cycle, at, scan, ran, complete, healthy. Whole: the full scan ran, and every scan that ran is complete with a healthy parser.
    """
    good = F.expr("complete and healthy")
    return scans.groupBy(group, "cycle").agg(
        F.max("at").alias("at"), F.bool_or(F.expr("scan = 'full' and ran")).alias("full"), F.bool_and(~F.col("ran") | good).alias("good"), F.bool_or(F.col("ran") & ~good).alias("troubled")
    ).withColumn("whole", F.col("full") & F.col("good")).drop("good")


def as_of_snapshots(rows: DataFrame, group: str) -> DataFrame:
    """Every cycle with the last whole snapshot: due (by what was committed before it), committed_at (with its own), age_minutes, degraded, unsafe, truncated.

    The as-of join is a running maximum over cycles of the times that were committed, so no two tables are joined by a range. Times grow with the cycles.
    """
    at = F.unix_timestamp(F.col("at").cast("timestamp"))
    kept = running(rows, group, "cycle", {"last": ("max", F.when(F.col("whole"), at)), "commits": ("sum", F.col("whole").cast("int"))})
    earlier = kept.where("whole").select(group, F.col("commits").alias("n"), F.col("last").alias("until"))
    joined = kept.withColumn("n", F.col("commits") - F.col("whole").cast("int")).join(earlier, [group, "n"], "left").withColumn("now", at)
    age = (F.col("now") - F.col("last")) / 60
    due = F.col("until").isNull() | (F.col("now") - F.col("until") >= DUE * 60)
    unsafe, degraded = F.col("last").isNull() | (age >= UNSAFE), F.col("last").isNull() | (age > DUE)
    return joined.select(
        group, "cycle", due.alias("due"), F.col("whole").alias("committed"), F.timestamp_seconds("last").alias("committed_at"), age.alias("age_minutes"), degraded.alias("degraded"), unsafe.alias("unsafe"), (F.col("troubled") | degraded).alias("truncated")
    )


def block_reasons(apartment_pages: Column, apartment_end: Column, apartment_novel: Column, house_pages: Column, house_end: Column, elapsed: Column, nav: Column, budget_ms: int, poll_ms: int) -> Column:
    """All reasons that a full scan does not prove coverage, in order; none if it does."""
    known = [
        ~apartment_end,
        ~apartment_end & (apartment_pages >= PAGE_CAP),
        ~apartment_end & (apartment_novel > 0),
        ~house_end,
        elapsed > budget_ms,
        elapsed > poll_ms / 2,
        apartment_end & (nav > 0) & ((apartment_pages + house_pages) * nav > budget_ms),
    ]
    return F.array_compact(F.array(*(F.when(c, name) for c, name in zip(known, BLOCKS))))
