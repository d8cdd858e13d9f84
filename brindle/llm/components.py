"""Connected components of an edge table, without gathering a neighbourhood in any one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b; bigint); root is the smallest node it reaches.

    Alternates the large-star and small-star steps until the edges stop changing. Each step is a
    partial-aggregated minimum and an equi-join, so a hub's edges are never held together; after each round the
    edges are a table in the shared folder. Null ends and loops are dropped; repeated edges count once; no edges
    give no rows.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(),
        "edges",
    )
    seen = None
    while True:  # the edges' ends only ever get smaller, so this ends
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").selectExpr("v as u", "m as v").union(lowest).distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.expr("xxhash64(u, v) % 4294967296"))).first()
        if state == seen:
            break
        seen = state
    return now.selectExpr("u as node", "v as root").union(now.selectExpr("v as node", "v as root").distinct())
