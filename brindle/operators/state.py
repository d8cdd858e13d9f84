"""Keyed state: folds of a batch into a table, status folds over event logs, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import streaks
from brindle.operators.stored import stored


def merged(state: DataFrame, batch: DataFrame, key: list[str], latest: list[str], least: list[str] = [], most: list[str] = [], order: list[str] = []) -> DataFrame:  # noqa: B006
    """`state` with `batch` folded in: new non-null values win in `latest` (the last by `order` within the batch),
    minima and maxima are kept in `least` and `most`. Folding the same batch twice changes nothing more."""
    folded = batch.groupBy(*key).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in latest), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most)
    )
    a, b = state.alias("a"), folded.alias("b")
    both = a.join(b, key, "full_outer")
    pick = lambda c, f: f(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return both.select(
        *key,
        *(pick(c, lambda x, y: F.coalesce(y, x)).alias(c) for c in latest),
        *(pick(c, F.least).alias(c) for c in least),
        *(pick(c, F.greatest).alias(c) for c in most),
    )


def merged_unique(state: DataFrame, batch: DataFrame, keys: list[str], latest: list[str], least: list[str], most: list[str]) -> DataFrame:
    """`state` with `batch` folded in, where each of `keys` is unique by itself: rows that clash on any, directly or through others, become one.

    Of such rows the one with the lowest `pos` gives its keys; all their keys stay in `aliases` (array of strings, in `state` only), so that a row that was merged is
    known again by any of them, and folds give the same in any number of batches; folding one again changes nothing. `latest` keeps the old value when the new one is null,
    the highest `pos` counts; minima and maxima are kept in `least` and `most`. Rows that clash are components over equal keys (null keys tie nothing).
    """
    from brindle.operators.graphs import key_components

    own = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys)))
    old = state.withColumns({"__new": F.lit(0), "aliases": F.array_union("aliases", own)})
    rows = old.unionByName(batch.withColumns({"__new": F.lit(1), "aliases": own}))
    tied = stored(rows.select("pos", F.explode("aliases").alias("key")).distinct())
    found = stored(rows.join(key_components(tied), "pos", "left").withColumn("component", F.coalesce("component", "pos")))
    order = F.struct("__new", "pos")
    known = found.select("component", F.explode("aliases").alias("alias")).groupBy("component").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    folded = found.groupBy("component").agg(
        *(F.min_by(c, F.struct("pos", "__new")).alias(c) for c in ["pos", *keys]),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in latest),
        *(F.min(c).alias(c) for c in least),
        *(F.max(c).alias(c) for c in most),
    )
    return folded.join(known, "component", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).select(*state.columns)


def recent_distinct(state: DataFrame, batch: DataFrame, by: str, value: str, at: str, n: int) -> DataFrame:
    """(by, value, at): of each group the last `n` different values in the order of their first appearance, `state` (the same columns) before `batch`.

    A value that is known keeps its place. Minima by value combine before the shuffle, and the rank is limited to `n` before it too; what is stored is
    bounded by `n` a group. A value that was dropped and comes again counts as new.
    """
    both = state.select(by, value, at).unionByName(batch.select(by, value, at)).where(F.col(value).isNotNull())
    first = both.groupBy(by, value).agg(F.min(at).alias(at))
    last = Window.partitionBy(by).orderBy(F.desc(at), F.desc(value))
    return first.withColumn("__rank", F.row_number().over(last)).where(f"__rank <= {n}").drop("__rank")


#: Days that rows of each table are kept, and days between two clean-ups.
RETENTION_DAYS = {"outbox": 30, "verdicts": 0, "holds": 1, "profiles": 90, "traces": 14}
CLEANUP_DAYS = 1


def cleaned(tables: dict[str, DataFrame], now: Column, last_cleanup: Column) -> dict[str, DataFrame]:
    """Tables with a column `at` without what is past its time, or as they are if the last clean-up is less than a day ago.

    Of the outbox only sent messages go; verdicts go when they run out, holds a day after their deadline; undated rows stay.
    """
    due = last_cleanup.isNull() | (now - last_cleanup >= F.expr(f"interval {CLEANUP_DAYS} days"))
    out = {}
    for name, df in tables.items():
        gone = F.col("at") < now - F.expr(f"interval {RETENTION_DAYS[name]} days")
        if name == "outbox":
            gone = gone & (F.col("status") == "sent")
        out[name] = df.where(~F.coalesce(gone & due, F.lit(False)))
    return out


def inserted_or_ignored(state: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """`state` and the first row of each new key; rows whose key is there are ignored."""
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n <= 1").drop("__n")
    return state.unionByName(first.join(state.select(*key), key, "left_anti").select(*state.columns))


def health_fold(events: DataFrame, source: str, order: list[str], healthy: Column, disabled: Column) -> DataFrame:
    """Per source: the streak of failures after its last healthy attempt (disabled ones change nothing), and its attempts.

    The last healthy attempt is a maximum and the streak a count of what came after it: both combine before the shuffle, however
    many attempts a source has. `last` is a row a source, and sent to all tasks only if it is small.
    """
    kept = events.withColumn("__ok", healthy).where(~F.coalesce(disabled, F.lit(False))).withColumn("__at", F.struct(*order))
    last = kept.groupBy(source).agg(F.max(F.when(F.col("__ok"), F.col("__at"))).alias("__last"))
    after = (~F.col("__ok")) & (F.col("__last").isNull() | (F.col("__at") > F.col("__last")))
    return kept.join(last, source).groupBy(source).agg(F.count_if(after).alias("consecutive_failures"), F.count("*").alias("n_attempts"))


def incidents(events: DataFrame, source: str, chunk: str, order: list[str], failed: Column, threshold: int = 3) -> DataFrame:
    """Per source: incidents opened (streaks that reach `threshold`) and recoveries (healthy attempts that end such a streak)."""
    return streaks(events, source, chunk, order, failed, threshold).select(source, "opened", "recovered")


def folded_transitions(events: DataFrame, key: str, chunk: str, order: list[str], event: str, states: list[str], moves: dict[tuple[str, str], str]) -> DataFrame:
    """(key, by_state, n): for each key the state that its events lead to from every state.

    What a chunk's events do to each state is folded first; over a key's chunks, which are few, these are put one after the
    other, so that a key of very many events is no single array.
    """
    steps = " ".join(f"when s = '{a}' and e.{event} = '{b}' then '{c}'" for (a, b), c in moves.items())
    begin = "map(" + ", ".join(f"'{s}', '{s}'" for s in states) + ")"
    one = F.expr(f"aggregate(log, {begin}, (m, e) -> transform_values(m, (k, s) -> case {steps} else s end))")
    chunks = events.groupBy(key, chunk).agg(F.array_sort(F.collect_list(F.struct(*order, event))).alias("log")).select(key, chunk, one.alias("m"), F.size("log").alias("n"))
    whole = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("c"), F.map_entries("m").alias("m")))).alias("all"), F.sum("n").alias("n"))
    return whole.select(key, F.expr(f"aggregate(all, {begin}, (m, x) -> transform_values(m, (k, s) -> try_element_at(map_from_entries(x.m), s)))").alias("by_state"), "n")


def retained(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows not older than `cutoff`; undated ones stay."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= cutoff))


def hold_action(decision: Column, now: Column, deadline: Column) -> Column:
    """What becomes of a held row: rejected ones drop, deferred ones are kept up to the deadline and then drop, others go out."""
    return F.when(decision == "reject", "drop").when((decision == "defer") & (now < deadline), "keep").when(decision == "defer", "drop").otherwise("send")


def _v1_to_v2(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"customer": "id", "label": "name"}).withColumns({"status": F.lit("pending"), "origin": F.lit("v1")})


def _v2_to_v3(df: DataFrame) -> DataFrame:
    return df.withColumn("attempts", F.lit(0).cast("bigint")).select("id", "name", "status", "origin", "attempts")


#: From each version of the outbox' schema to the next; forward only.
MIGRATIONS = (_v1_to_v2, _v2_to_v3)


def migrated(df: DataFrame, version: int, steps: tuple) -> DataFrame:
    """A table of the given version (from 1) as the last one has it; every row is kept, and nothing is done to a table of the last version."""
    for step in steps[version - 1 :]:
        df = step(df)
    return df.select("id", "name", "status", "origin", "attempts")


def terminally_rejected(holds: DataFrame, seen: DataFrame, batch: DataFrame, dry: bool) -> tuple[DataFrame, DataFrame]:
    """(holds, seen) after a batch of terminal rejects by id; a dry run leaves both as they are."""
    if dry:
        return holds, seen
    return holds.join(batch, "id", "left_anti"), seen.unionByName(batch.join(seen, "id", "left_anti"))


def channel_pauses(events: DataFrame, channel: str, order: list[str], failed: Column) -> DataFrame:
    """(channel, failures, at, delay_ms): failures of each channel since its last success, the last attempt, and the pause they ask for.

    Aggregates only: the last success is a maximum, and what failed after it is counted, so no channel's rows come together in one task.
    """
    rows = events.withColumn("__at", F.struct(*order)).withColumn("__failed", failed)
    last = rows.groupBy(channel).agg(F.max(F.when(~F.col("__failed"), F.col("__at"))).alias("__ok"), F.max(order[0]).alias("at"))
    counts = rows.join(last, channel).groupBy(channel).agg(F.count_if(F.col("__failed") & (F.col("__ok").isNull() | (F.col("__at") > F.col("__ok")))).alias("failures"), F.max("at").alias("at"))
    return counts.withColumn("delay_ms", F.when(F.col("failures") > 0, backoff_ms(F.col("failures"), F.lit(None), base=600_000)))


def backoff_ms(attempt: Column, retry_after_ms: Column, base: int = 120_000, cap: int = 21_600_000) -> Column:
    """base * 2 ** (attempt - 1), the exponent 8 at most, capped, but never less than what the server asks for."""
    exponent = F.least(F.lit(8), F.greatest(F.lit(0), attempt - 1))
    grown = F.least(F.lit(cap).cast("bigint"), (F.lit(base) * F.pow(F.lit(2), exponent)).cast("bigint"))
    return F.greatest(grown, F.coalesce(retry_after_ms, F.lit(0)).cast("bigint"))
