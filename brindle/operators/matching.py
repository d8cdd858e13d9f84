"""Joins: unseen rows, identity keys, caches with a time to live, and greedy keepers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.stored import stored
#: Reasons that confirm a duplicate, best first, and the classes of identity keys, weakest first.
REASONS = ["explicit_external_listing_id", "explicit_external_url", "same_platform_listing_id", "same_canonical_url", "lun_group_id"]
CLASSES = ["lun_cluster", "own", "explicit_external"]
PLATFORM_KEYS = ["olx:token:", "rieltor:id:", "domria:id:"]


def unseen(df: DataFrame, seen: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of `df` that `seen` has by none of the keys: an anti-join for each key, never one join with OR."""
    return reduce(lambda left, key: left.join(seen.select(*key).distinct(), key, "left_anti"), keys, df)


def best_class(keys: DataFrame) -> DataFrame:
    """(source, source_id, key, key_class): of a listing's equal keys the one of the strongest class."""
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("key_class"))
    return keys.groupBy("source", "source_id", "key").agg(F.max_by("key_class", rank).alias("key_class"))


def confirm_reason(key: Column, ours: Column, theirs: Column) -> Column:
    """Why an equal key makes two listings duplicates; null if it does not."""
    starts = lambda prefixes: reduce(lambda a, b: a | b, (key.startswith(p) for p in prefixes))
    explicit, own = (ours == "explicit_external") | (theirs == "explicit_external"), (ours == "own") & (theirs == "own")
    return (
        F.when(key.startswith("lun:group:") & (ours == "lun_cluster") & (theirs == "lun_cluster"), REASONS[4])
        .when(key.startswith("lun:"), None)
        .when(explicit & starts(PLATFORM_KEYS), REASONS[0])
        .when(explicit & key.startswith("url:"), REASONS[1])
        .when(own & starts(PLATFORM_KEYS), REASONS[2])
        .when(own & key.startswith("url:"), REASONS[3])
    )


def key_matches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Listings of `ours` against known keys: (source, source_id, peer_source, peer_id, key, reason), never themselves.

    Keys are exploded and joined by equality; a key that very many listings share is a skewed join key, which
    adaptive execution splits.
    """
    peers = theirs.select("key", F.col("source").alias("peer_source"), F.col("source_id").alias("peer_id"), F.col("key_class").alias("peer_class"))
    joined = ours.join(peers, "key").where("not (source = peer_source and source_id = peer_id)")
    return joined.withColumn("reason", confirm_reason(F.col("key"), F.col("key_class"), F.col("peer_class"))).where("reason is not null").select("source", "source_id", "peer_source", "peer_id", "key", "reason")


def best_matches(keys: DataFrame) -> DataFrame:
    """For each listing, key and class of other listings with that key the first of these: the rows of `key_matches(keys, keys)` that can be best, without pairs.

    A key's first two listings of each class are minima, combined before the shuffle; the first that is not the listing itself is its peer. A reason depends on the key and
    both classes only, so reasons and best peers are those of all pairs. `keys`: one row a listing and key.
    """
    who = F.struct("source", "source_id")
    first = keys.groupBy("key", F.col("key_class").alias("peer_class")).agg(F.min(who).alias("lo"))
    same = (F.col("k.key") == F.col("f.key")) & (F.col("k.key_class") == F.col("f.peer_class"))
    others = keys.alias("k").join(first.alias("f"), same).select("f.key", "f.peer_class", "f.lo", F.struct("k.source", "k.source_id").alias("own"))
    two = others.groupBy("key", "peer_class").agg(F.first("lo").alias("lo"), F.min(F.when(F.col("own") != F.col("lo"), F.col("own"))).alias("next"))
    joined = keys.join(two, "key").withColumn("peer", F.when(F.col("lo") != who, F.col("lo")).otherwise(F.col("next"))).where("peer is not null")
    found = joined.withColumn("reason", confirm_reason(F.col("key"), F.col("key_class"), F.col("peer_class"))).where("reason is not null")
    return found.select("source", "source_id", F.col("peer.source").alias("peer_source"), F.col("peer.source_id").alias("peer_id"), "key", "reason")


def verdicts(listings: DataFrame, matches: DataFrame, overlaps: DataFrame) -> DataFrame:
    """verdict, best peer and reasons (best first) of every listing: confirmed_duplicate, possible_duplicate or unique."""
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    hits = matches.withColumn("rank", rank).groupBy("source", "source_id").agg(
        F.min_by(F.concat_ws("/", "peer_source", "peer_id"), F.struct("rank", "peer_source", "peer_id")).alias("duplicate_of"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "reason"))), lambda x: x["reason"]), ",").alias("reasons"),
    )
    flagged = listings.join(hits, ["source", "source_id"], "left").join(overlaps.select("source", "source_id").distinct().withColumn("__overlap", F.lit(True)), ["source", "source_id"], "left")
    verdict = F.when(F.col("duplicate_of").isNotNull(), "confirmed_duplicate").when(F.col("__overlap"), "possible_duplicate").otherwise("unique")
    return flagged.withColumn("verdict", verdict).drop("__overlap")


def attribute_overlap(df: DataFrame, on: list[str], identity: list[str], valid: Column) -> DataFrame:
    """Rows that share all of `on` with another listing: a count of different listings a group, not pairs."""
    sized = df.where(valid).groupBy(*on).agg(F.count_distinct(*identity).alias("__n")).where("__n > 1")
    return df.where(valid).join(sized, on).drop("__n")


def keepers(keys: DataFrame, components: DataFrame) -> DataFrame:
    """(pos, kept): in the order of `pos` a row is kept if it shares no key with a row kept before it.

    `keys`: pos, key; `components`: pos, component. Only rows of a component depend on each other, so partitions are
    dealt by component and folded in one pass; what is held is the keys of one component (one listing's copies).
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, pos, own, taken = None, None, [], set()

        def decided() -> tuple[int, bool]:
            keep = taken.isdisjoint(own)
            if keep:
                taken.update(own)
            return pos, keep

        for batch in batches:
            out = []
            for c, p, k in zip(batch["component"].tolist(), batch["pos"].tolist(), batch["key"].tolist()):
                if (c, p) != (component, pos):
                    if pos is not None:
                        out.append(decided())
                    if c != component:
                        taken = set()
                    component, pos, own = c, p, []
                own.append(k)
            yield pd.DataFrame(out, columns=["pos", "kept"])
        if pos is not None:
            yield pd.DataFrame([decided()], columns=["pos", "kept"])

    rows = keys.join(components, "pos").select("component", "pos", "key")
    return rows.repartition("component").sortWithinPartitions("component", "pos").mapInPandas(fold, "pos long, kept boolean")


def first_come(keys: DataFrame) -> DataFrame:
    """The rows (pos) of `keys` (pos, key) that share no key with a row kept before them, in the order of pos.

    Rounds: a row that is the first of all its keys is kept, and those that share a key with it are not. Each round is a minimum a key, combined before the
    shuffle, and equi-joins; nothing gathers the rows of a key or of a component in one task. The first row left is always decided, so this ends.
    """
    left, kept = stored(keys.distinct()), []
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min("pos").alias("first"))
        winners = stored(left.join(first, "key").groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("first")).alias("wins")).where("wins").select("pos"))
        kept.append(winners)
        taken = left.join(winners, "pos", "left_semi").select("key").distinct()
        decided = left.join(taken, "key", "left_semi").select("pos").distinct()
        left = stored(left.join(decided, "pos", "left_anti"))
    return reduce(DataFrame.union, kept) if kept else left.select("pos")


def tied_to(keys: DataFrame, bad: DataFrame) -> DataFrame:
    """(source, source_id) of the listings that share an explicit key with another one that is in `bad` (source, source_id).

    A key's bad listings are told by the first and the last of them, among all and among those that name it explicitly: another one than
    the listing itself is there if one of the two is not itself. So a key gives one row, not pairs.
    """
    who, explicit = F.struct("source", "source_id"), F.col("key_class") == "explicit_external"
    usable = keys.where(~F.col("key").startswith("lun:"))
    named = usable.join(bad.distinct(), ["source", "source_id"], "left_semi").groupBy("key").agg(
        *(f(F.when(c, who)).alias(n) for n, f, c in (("lo", F.min, F.lit(True)), ("hi", F.max, F.lit(True)), ("lo_explicit", F.min, explicit), ("hi_explicit", F.max, explicit)))
    )
    other = lambda lo, hi: (F.col(lo) != who) | (F.col(hi) != who)
    hit = F.when(explicit, other("lo", "hi")).otherwise(other("lo_explicit", "hi_explicit"))
    return usable.join(named, "key").where(hit).select("source", "source_id").distinct()


def live_cache(df: DataFrame, cache: DataFrame, key: list[str], now: Column) -> DataFrame:
    """`df` with the cached verdict of its key if that has not expired."""
    return df.join(cache.where(F.col("expires_at") > now), key, "left")


def planned_fetches(ids: DataFrame, known: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """ids with plan: known, fetch (the first `cap` unknown of the group), or deferred.

    Only the first `cap` of a group are ranked past the shuffle, which the planner's limit by group sees to.
    """
    marked = ids.join(known.distinct().withColumn("__known", F.lit(True)), "id", "left")
    unknown = marked.where("__known is null").select(group, "id", *(c for c in order if c not in (group, "id")))
    first = unknown.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(f"__rank <= {cap}").select(group, "id", F.lit(True).alias("__first"))
    plan = F.when(F.col("__known"), "known").when(F.col("__first"), "fetch").otherwise("deferred")
    return marked.join(first, [group, "id"], "left").withColumn("plan", plan).drop("__known", "__first")
