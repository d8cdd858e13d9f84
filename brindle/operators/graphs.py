"""Connected components of rows that share keys, without gathering a neighbourhood in any one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.stored import stored

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node that it reaches.

    Large-star and small-star steps by turns until nothing changes: both are a partial-aggregated minimum and an equi-join. The
    number of rounds grows with the logarithm of the longest path. Lineage is cut by checkpoints.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    seen = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(large.join(lowest, "u").where("v <> m").selectExpr("v as u", "m as v").union(lowest).distinct())
        sums = now.agg(F.count("*"), F.sum(F.expr("xxhash64(u, v) % 4294967296"))).first()
        if sums == seen:
            return now.selectExpr("u as node", "v as root").union(now.selectExpr("v as node", "v as root").distinct())
        seen = sums


def key_components(keys: DataFrame) -> DataFrame:
    """(pos, component) of every row of `keys` (pos, key): the smallest pos reachable over shared keys.

    Each row is tied to the first that has its key, so a key gives as many edges as rows.
    """
    first = keys.groupBy("key").agg(F.min("pos").alias("first"))
    found = components(keys.join(first, "key").selectExpr("pos as a", "first as b"))
    return keys.select("pos").distinct().join(found.withColumnRenamed("node", "pos"), "pos", "left").select("pos", F.coalesce("root", "pos").alias("component"))
