"""Page walks: where a walk stops, why, and what it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.decisions import first_rule

#: Reasons that end a walk before its time.
TRUNCATIONS = ["time_budget", "timeout", "http_error", "parser_failure", "page_mismatch", "total_pages_changed", "repeated_page", "premature_empty", "safety_cap", "incomplete", "schema_reject", "acquired_response_cap"]
#: Ends that make a walk whole.
ENDS = ["empty", "total", "pages"]
CHUNK = 1000


def running(df: DataFrame, by: str, place: str, kinds: dict[str, tuple[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """`df` with running sums and maxima by `place`: name -> ('sum' or 'max', value).

    Places are cut into chunks: what a chunk adds is put together over a group's chunks, and rows are put in order inside their chunk only. So a group of
    any length is no single task; a group of a billion rows has a million chunks of a thousand.
    """
    fold = {"sum": F.sum, "max": F.max}
    rows = df.withColumn("__chunk", F.floor(F.col(place) / chunk))
    for name, (_, value) in kinds.items():
        rows = rows.withColumn(name, value)
    before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(by, "__chunk").agg(*(fold[k](n).alias(n) for n, (k, _) in kinds.items()))
    chunks = chunks.select(by, "__chunk", *(fold[k](n).over(before).alias(f"__{n}") for n, (k, _) in kinds.items()))
    inside = Window.partitionBy(by, "__chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    rows = rows.join(chunks, [by, "__chunk"])
    for name, (kind, _) in kinds.items():
        rows = rows.withColumn(name, both[kind](F.col(f"__{name}"), fold[kind](name).over(inside)))
    return rows.drop("__chunk", *(f"__{n}" for n in kinds))


def page_walks(pages: DataFrame, items: DataFrame, budget_ms: int, cap: int, most: int) -> DataFrame:
    """Walks over numbered pages up to the first that ends them: (walk, pages, n_ids, whole, reasons, first_page_failed).

    `pages`: walk, page (from 1, without gaps), elapsed_ms when it was asked for, error (null, timeout or another), status, parsed, shown (the page number that it shows),
    declared (items) and declared_pages, as far as it says, and rejects. `items`: walk, page, id. Reasons, first come first at a page: the time is up; a
    timeout or another error; a page that cannot be parsed; another page number than asked for; another number of pages than
    before; a page with the same ids as an earlier one; an empty page before all that was declared was seen; the last page that may be read. A walk is whole if it comes to an empty page, to
    all declared ids (the most ever declared), or to the last page. A walk that just ends is incomplete; rejected rows and more than `most` ids on the pages read make any walk partial.

    Every condition is a property of a page and of running sums and maxima; the end is the first page that has one, a minimum by walk.
    """
    first = items.groupBy("walk", "id").agg(F.min("page").alias("page"))
    new = first.groupBy("walk", "page").agg(F.count("*").alias("n_new"))
    sets = items.groupBy("walk", "page").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count("*").alias("n_rows"))  # a page is bounded by what a site shows
    again = sets.groupBy("walk", "ids").agg(F.min("page").alias("first_shown"))
    sets = sets.join(again, ["walk", "ids"]).select("walk", "page", "n_rows", (F.col("page") > F.col("first_shown")).alias("repeated"))
    rows = pages.join(new, ["walk", "page"], "left").join(sets, ["walk", "page"], "left").fillna({"n_new": 0, "n_rows": 0, "repeated": False})
    stated = F.col("declared_pages").isNotNull()
    rows = running(
        rows,
        "walk",
        "page",
        {
            "n_ids": ("sum", F.col("n_new")),
            "n_seen": ("sum", F.col("n_rows")),
            "total": ("max", F.col("declared")),
            "last_stated": ("max", F.when(stated, F.struct("page", "declared_pages"))),
            "earliest_stated": ("max", F.when(stated, F.struct((-F.col("page")).alias("page"), "declared_pages"))),
            "n_rejects": ("sum", F.col("rejects")),
        },
    )
    rule = first_rule(
        [
            (F.expr(f"page > 1 and elapsed_ms >= {budget_ms}"), "time_budget"),
            (F.expr("error = 'timeout'"), "timeout"),
            (F.expr("error is not null or status <> 200"), "http_error"),
            (F.expr("not parsed"), "parser_failure"),
            (F.expr("shown is not null and shown <> page"), "page_mismatch"),
            (F.expr("declared_pages is not null and declared_pages <> earliest_stated.declared_pages"), "total_pages_changed"),
            (F.col("repeated"), "repeated_page"),
            (F.expr("n_rows = 0 and total > 0 and n_ids < total and n_seen < total"), "premature_empty"),
            (F.expr("n_rows = 0"), "empty"),
            (F.expr("total > 0 and n_ids >= total"), "total"),
            (F.expr("page >= last_stated.declared_pages"), "pages"),
            (F.expr(f"page >= {cap}"), "safety_cap"),
        ],
        None,
    )
    # a page counts as read unless what is wrong with it is known before its items are
    unread = ["time_budget", "timeout", "http_error", "parser_failure", "page_mismatch", "total_pages_changed", "repeated_page"]
    told = rows.withColumn("rule", rule).withColumn("read", ~F.coalesce(F.col("rule").isin(unread), F.lit(False)))
    less = lambda c, mine: F.col(c) - F.when(F.col("read"), 0).otherwise(F.col(mine))
    told = told.select("walk", "page", "rule", less("n_ids", "n_new").alias("n_ids"), less("n_rejects", "rejects").alias("n_rejects"), (F.col("page") - (~F.col("read")).cast("int")).alias("pages"))
    of = F.struct("page", "rule", "n_ids", "n_rejects", "pages")
    ends = told.groupBy("walk").agg(F.min(F.when(F.col("rule").isNotNull(), of)).alias("stop"), F.max(of).alias("last"))
    end = F.coalesce("stop", "last")
    found = ends.select("walk", end["rule"].alias("rule"), end["n_ids"].alias("n_ids"), end["n_rejects"].alias("n_rejects"), end["pages"].alias("pages"))
    failed = F.expr("pages = 0")  # nothing was read: an outage, no truncation
    reasons = F.array_compact(
        F.array(
            F.when(~failed & (F.col("rule").isNull() | ~F.col("rule").isin(ENDS)), F.coalesce("rule", F.lit("incomplete"))),
            F.when(F.col("n_rejects") > 0, "schema_reject"),
            F.when(F.col("n_ids") > most, "acquired_response_cap"),
        )
    )
    return found.select("walk", "pages", "n_ids", (F.coalesce(F.col("rule").isin(ENDS), F.lit(False)) & (F.size(reasons) == 0)).alias("whole"), F.array_join(reasons, ",").alias("reasons"), failed.alias("first_page_failed"))
