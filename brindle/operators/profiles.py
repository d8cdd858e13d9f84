"""Sellers' profiles: what a seller's rows say together, under policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.decisions import first_rule, yes

#: Accounts younger than this are a risk, the year of registration that is excluded, and addresses remembered of a seller.
YOUNG_DAYS, EXCLUDED_YEAR, ADDRESSES = 7, 2026, 8


def profile_verdict(owner: Column, readable: Column, year: Column, created: Column, likely: Column, now: Column) -> Column:
    """The profile's verdict. An unreadable profile is unknown, never an owner's."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))
    return first_rule(
        [
            (year == EXCLUDED_YEAR, "seller_registration_year_2026"),
            (owner, "confirmed_owner"),
            ((age >= 0) & (age < YOUNG_DAYS * 86_400), "profile_high_risk"),
            (likely, "profile_likely_intermediary"),
            (~readable, "unknown"),
        ],
        "unknown",
    )


def rejected_profile(verdict: Column, likely_policy: Column, new_policy: Column) -> Column:
    always = verdict.isin("confirmed_intermediary", "seller_registration_year_2026", "seller_inventory_limit", "seller_mass_inventory")
    return always | yes((verdict == "profile_likely_intermediary") & (likely_policy == "reject")) | yes((verdict == "profile_high_risk") & (new_policy == "reject"))


def profile_gate(rows: DataFrame, now: Column, likely_policy: Column, new_policy: Column) -> DataFrame:
    """`rows` with verdict and kept. Columns: source, seller (null: judged by itself), owner, readable, year, created, likely.

    A seller's rows are judged together: an owner only if all rows say so, the earliest creation date, likely if any is. Of a rejected seller, rows that the platform
    confirms as an owner's stay. Sums by seller combine before the shuffle; rows without a seller are not shuffled together.
    """
    by = ["source", "seller"]
    sellers = rows.where("seller is not null").groupBy(by).agg(
        F.bool_and("owner").alias("all_owner"), F.bool_or("readable").alias("any_readable"), F.max(F.when(F.col("year") == EXCLUDED_YEAR, F.col("year"))).alias("any_year"), F.min("created").alias("first_created"), F.bool_or("likely").alias("any_likely")
    )
    together = rows.where("seller is not null").join(sellers, by).withColumn("verdict", profile_verdict(F.col("all_owner"), F.col("any_readable"), F.col("any_year"), F.col("first_created"), F.col("any_likely"), now)).select(*rows.columns, "verdict")
    alone = rows.where("seller is null").withColumn("verdict", F.when(F.col("owner"), "confirmed_owner").when(F.col("likely"), "profile_likely_intermediary").otherwise("unknown"))
    both = together.unionByName(alone)
    return both.withColumn("kept", ~rejected_profile(F.col("verdict"), likely_policy, new_policy) | F.col("owner"))
