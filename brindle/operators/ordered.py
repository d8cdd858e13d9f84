"""Order-dependent operators: first per key, caps, round robin, sequences. Every order is total, so results do not vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(names: list) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def ranked(df: DataFrame, by: list, order: list, name: str = "__rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_columns(by)).orderBy(*_columns(order))))


def keep_first(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each key; a limit on the rank lets the planner drop rows before the shuffle."""
    return ranked(df, by, order).where("__rank <= 1").drop("__rank")


def cap_per_group(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """At most `cap` rows of each group in order, with `truncated`: whether its group had more."""
    kept = ranked(df, [group], order).where(f"__rank <= {cap + 1}")
    over = F.max(F.col("__rank") > cap).over(Window.partitionBy(group))
    return kept.withColumn("truncated", over).where(f"__rank <= {cap}").drop("__rank")


def round_robin(df: DataFrame, first: str, source: str, order: list, limit: int) -> DataFrame:
    """Rows with `first` before the others; within these one row a source and pass, sources in order; `limit` at most."""
    turn = ranked(df, [first, source], order, "turn").where(f"turn <= {limit}")
    return turn.orderBy(F.desc(first), "turn", source).limit(limit)


def consuming_round_robin(df: DataFrame, first: str, source: str, place: str, key: list[str], cap: int) -> DataFrame:
    """At most `cap` rows with their order `rank`: rows with `first`, then all that are left, in each phase a row a source and pass; duplicates are used up without being kept.

    A pass in which every source's next row is a duplicate ends its phase, whatever comes after it. `key` tells duplicates and contains the source. With `cap` rows or
    fewer all are kept, duplicates too. A row's pass is its number in its source, which is counted over chunks; the pass that ends a phase is the first
    without a fresh row, so nothing is done pass by pass.
    """
    from brindle.operators.walks import running

    if df.limit(cap + 1).count() <= cap:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(place)))  # `cap` rows at most

    def phase(rows: DataFrame, taken: DataFrame | None, left: int) -> tuple[DataFrame, int]:
        turns = running(rows, source, place, {"turn": ("sum", F.lit(1))})
        fresh = turns.groupBy(*key).agg(F.min("turn").alias("turn")).withColumn("fresh", F.lit(True))
        fresh = fresh if taken is None else fresh.join(taken.select(*key).distinct(), key, "left_anti")
        marked = turns.join(fresh, [*key, "turn"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        end = marked.groupBy("turn").agg(F.bool_or("fresh").alias("any")).agg(F.min(F.when(~F.col("any"), F.col("turn"))), F.max("turn") + 1).first()
        end = end[0] if end[0] is not None else end[1]
        kept = marked.where(F.col("fresh") & (F.col("turn") < end)).orderBy("turn", source).limit(left)
        return marked.withColumn("used", F.col("turn") <= end).join(kept.select(*key, "turn").withColumn("kept", F.lit(True)), [*key, "turn"], "left"), end

    preferred, _ = phase(df.where(F.col(first)), None, cap)
    preferred = preferred.checkpoint()
    one = preferred.where("kept")
    n = one.count()
    rest = df.where(~F.col(first)).unionByName(preferred.where("not used").select(*df.columns))
    parts = [one.select(*df.columns, "turn", F.lit(0).alias("phase"))]
    if n < cap:
        second, _ = phase(rest, one, cap - n)
        parts.append(second.where("kept").select(*df.columns, "turn", F.lit(1).alias("phase")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.withColumn("rank", F.row_number().over(Window.orderBy("phase", "turn", source))).drop("phase", "turn")  # `cap` rows at most


def last_distinct(df: DataFrame, by: str, key: str, order: list, n: int) -> DataFrame:
    """The last `n` different keys of each group, in the order of their first appearance."""
    first = keep_first(df, [by, key], order)
    return ranked(first, [by], [F.desc(c) for c in order]).where(f"__rank <= {n}").drop("__rank")


def non_increasing(df: DataFrame, by: str, value: str, order: list, least: int = 3) -> DataFrame:
    """Per group: rows, and whether the values never grow (null with fewer than `least` rows counts as false)."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*_columns(order)))
    steps = df.withColumn("__falls", F.coalesce(F.col(value) <= before, F.lit(True)))
    return steps.groupBy(by).agg(F.count("*").alias("n_rows"), F.bool_and("__falls").alias("falls")).withColumn("non_increasing", F.expr(f"falls and n_rows >= {least}")).drop("falls")


def until_crossed(df: DataFrame, by: str, newest: list[str], crossed: Column) -> DataFrame:
    """Rows from the newest down to and with the first for which `crossed` holds: that row is a maximum by group, so no group is put in order."""
    rows = df.withColumn("__at", F.struct(*newest))
    edge = rows.where(crossed).groupBy(by).agg(F.max("__at").alias("__edge"))
    return rows.join(edge, by, "left").where(F.col("__edge").isNull() | (F.col("__at") >= F.col("__edge"))).drop("__at", "__edge")


def novelty(df: DataFrame, key: str, page: str) -> DataFrame:
    """Per page: different keys, and how many of them are on no earlier page."""
    seen = df.groupBy(key, page).agg(F.lit(1).alias("one"))
    first = seen.withColumn("fresh", F.min(page).over(Window.partitionBy(key)) == F.col(page))
    return first.groupBy(page).agg(F.count("*").alias("n_keys"), F.count_if(F.col("fresh")).alias("n_new"))


def streaks(df: DataFrame, by: str, chunk: str, order: list, failed: Column, threshold: int = 3) -> DataFrame:
    """Per group: its longest run of failures, runs of `threshold` or more (`opened`), those ended by a success (`recovered`), and the run it ends with.

    `chunk` grows with the order, a day for instance. Runs are found inside chunks; what a chunk begins and ends with is then
    put together over a group's chunks, which are few, so that a group of very many rows is no single task.
    """
    inside = Window.partitionBy(by, chunk).orderBy(*_columns(order))
    rows = df.withColumn("__bad", failed).withColumn("__run", F.count_if(~F.col("__bad")).over(inside))
    runs = rows.groupBy(by, chunk, "__run").agg(F.count_if("__bad").alias("__n"))
    whole = runs.groupBy(by, chunk).agg(F.max("__run").alias("last"), F.max("__n").alias("longest"), F.max(F.when(F.col("__run") == 0, F.col("__n"))).alias("head"), F.max_by("__n", "__run").alias("tail"))
    inner = runs.join(whole.select(by, chunk, "last"), [by, chunk]).where(f"__run > 0 and __run < last and __n >= {threshold}").groupBy(by, chunk).agg(F.count("*").alias("inner"))
    parts = whole.join(inner, [by, chunk], "left").select(by, chunk, "longest", F.coalesce("head", F.lit(0)).alias("head"), "tail", F.coalesce("inner", F.lit(0)).alias("inner"), (F.col("last") == 0).alias("through"))
    ordered_ = Window.partitionBy(by).orderBy(chunk)
    parts = parts.withColumn("__since", F.count_if(~F.col("through")).over(ordered_))
    carried = F.sum("tail").over(Window.partitionBy(by, "__since").orderBy(chunk))  # through chunks add up, others begin anew with their tail
    parts = parts.withColumn("__carry", carried).withColumn("__before", F.coalesce(F.lag("__carry").over(ordered_), F.lit(0)))
    closed = F.expr(f"not through and __before + head >= {threshold}")
    found = parts.groupBy(by).agg(
        F.max(F.greatest("longest", F.col("__before") + F.col("head"))).alias("longest_streak"), (F.count_if(closed) + F.sum("inner")).alias("recovered"), F.max_by("__carry", chunk).alias("open_streak")
    )
    return found.withColumn("opened", F.col("recovered") + (F.col("open_streak") >= threshold).cast("int"))


def longest_streaks(df: DataFrame, by: str, chunk: str, order: list, failed: Column) -> DataFrame:
    """Longest run of failures of each group; groups without any are absent."""
    return streaks(df, by, chunk, order, failed).where("longest_streak > 0").select(by, "longest_streak")
