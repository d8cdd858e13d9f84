"""Queries over page walks: where they end, and incremental walks read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import walks
from brindle.plans.base import bound, plain, query, scratch, table
from brindle.sources.walks import PageWalk
from brindle.streaming.stateful import run_to_end

_NUMBERED = "SELECT o_custkey AS walk, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page, o_orderkey AS k, (o_orderkey * 7919 + o_custkey * 31) % 1000 AS e FROM {orders}"
_PAGES = f"""SELECT walk, page, page * (walk % 9) * 1000 AS elapsed_ms, CASE WHEN e < 12 THEN 'timeout' WHEN e < 24 THEN 'reset' END AS error, CASE WHEN e BETWEEN 24 AND 35 THEN 503 ELSE 200 END AS status, e NOT BETWEEN 36 AND 47 AS parsed,
  CASE WHEN e BETWEEN 48 AND 59 THEN page + 1 WHEN e % 3 <> 0 THEN page END AS shown, CASE WHEN walk % 4 <> 0 THEN 5 + walk % 40 + e % 3 END AS declared, CASE WHEN walk % 3 = 0 THEN NULL WHEN e BETWEEN 60 AND 75 THEN 3 + walk % 9 ELSE 2 + walk % 9 END AS declared_pages,
  CASE WHEN e BETWEEN 76 AND 90 THEN 2 ELSE 0 END AS rejects FROM ({_NUMBERED})"""
_ITEMS = f"SELECT walk, page, CASE WHEN walk % 5 = 0 THEN l_linenumber % 2 ELSE l_partkey % 97 END AS id FROM ({_NUMBERED}) JOIN {{lineitem}} ON l_orderkey = k WHERE e NOT BETWEEN 100 AND 220"
_BUDGET_MS, _CAP, _MOST = 45_000, 9, 30
_WALKED = f"""
WITH RECURSIVE pg AS MATERIALIZED ({plain(_PAGES)}), it AS MATERIALIZED (SELECT walk, page, list_sort(list(DISTINCT id)) AS ids, count(*) AS n FROM ({plain(_ITEMS)}) GROUP BY walk, page),
r AS (SELECT DISTINCT walk, 0 AS page, []::BIGINT[] AS seen, []::VARCHAR[] AS sets, 0::BIGINT AS n, NULL::BIGINT AS total, NULL::BIGINT AS first_dp, NULL::BIGINT AS last_dp, 0::BIGINT AS rejects, 0 AS pages, NULL::VARCHAR AS rule FROM pg
  UNION ALL SELECT walk, page, CASE WHEN bad THEN seen ELSE both_ids END, CASE WHEN bad THEN sets ELSE list_append(sets, key) END, n, total, first_dp, last_dp, CASE WHEN bad THEN rejects ELSE rejects + more END, CASE WHEN bad THEN page - 1 ELSE page END, rule
  FROM (SELECT *, coalesce(rule IN ('time_budget', 'timeout', 'http_error', 'parser_failure', 'page_mismatch', 'total_pages_changed', 'repeated_page'), false) AS bad
    FROM (SELECT *, CASE WHEN page > 1 AND elapsed_ms >= {_BUDGET_MS} THEN 'time_budget' WHEN error = 'timeout' THEN 'timeout' WHEN error IS NOT NULL OR status <> 200 THEN 'http_error' WHEN NOT parsed THEN 'parser_failure' WHEN shown <> page THEN 'page_mismatch'
        WHEN dp <> first_dp THEN 'total_pages_changed' WHEN here > 0 AND list_contains(sets, key) THEN 'repeated_page' WHEN here = 0 AND total > 0 AND len(both_ids) < total AND n < total THEN 'premature_empty' WHEN here = 0 THEN 'empty'
        WHEN total > 0 AND len(both_ids) >= total THEN 'total' WHEN page >= last_dp THEN 'pages' WHEN page >= {_CAP} THEN 'safety_cap' END AS rule
      FROM (SELECT r.walk, pg.page, r.seen, r.sets, r.n + coalesce(it.n, 0) AS n, coalesce(it.n, 0) AS here, coalesce(greatest(r.total, pg.declared), r.total, pg.declared) AS total, coalesce(r.first_dp, pg.declared_pages) AS first_dp, coalesce(pg.declared_pages, r.last_dp) AS last_dp, pg.declared_pages AS dp,
          r.rejects, pg.rejects AS more, pg.elapsed_ms, pg.error, pg.status, pg.parsed, pg.shown, CAST(it.ids AS VARCHAR) AS key, list_distinct(list_concat(r.seen, coalesce(it.ids, []))) AS both_ids
        FROM r JOIN pg ON pg.walk = r.walk AND pg.page = r.page + 1 LEFT JOIN it ON it.walk = pg.walk AND it.page = pg.page WHERE r.rule IS NULL)))),
e AS (SELECT walk, arg_max(rule, page) AS rule, arg_max(pages, page) AS pages, arg_max(len(seen), page) AS n_ids, arg_max(rejects, page) AS rejects FROM r GROUP BY walk),
w AS (SELECT *, coalesce(rule, 'none') IN ('empty', 'total', 'pages') AS ended, concat_ws(',', CASE WHEN pages > 0 AND coalesce(rule, 'none') NOT IN ('empty', 'total', 'pages') THEN coalesce(rule, 'incomplete') END, CASE WHEN rejects > 0 THEN 'schema_reject' END, CASE WHEN n_ids > {_MOST} THEN 'acquired_response_cap' END) AS reasons FROM e)
SELECT walk, pages, n_ids, ended AND reasons = '' AS whole, reasons, pages = 0 AS first_page_failed FROM w
"""


@query(_WALKED)
def str10_str12_page_walks(spark, sf):
    """Walks over all pages of each customer's orders: every reason to stop occurs, and the first one counts."""
    pages, items = bound(spark, sf, _PAGES), bound(spark, sf, _ITEMS)
    found = walks.page_walks(pages, items, _BUDGET_MS, _CAP, _MOST)
    return found.select("walk", "pages", F.col("n_ids").cast("bigint").alias("n_ids"), "whole", "reasons", "first_page_failed")


_CYCLES, _TURN = 7, 4
_SHOWN = """
WITH c AS (SELECT cycle, TIMESTAMP_NTZ '2024-01-04 00:00:00' + cycle * INTERVAL 4 DAYS AS at FROM {cycles}), n AS (SELECT greatest(5, count(*) // 100) AS size FROM {events}),
s AS (SELECT c.cycle, e.event_type AS category, e.event_id AS id, e.ts AS published, row_number() OVER (PARTITION BY c.cycle, e.event_type ORDER BY e.ts DESC, e.event_id DESC) - 1 AS r FROM {events} e JOIN c ON e.ts <= c.at),
p AS (SELECT cycle, category, CAST(r // size + 1 AS INT) AS page, CAST(r % size AS INT) AS pos, id, published FROM s CROSS JOIN n)
SELECT cycle, category, page, CASE WHEN (cycle * 31 + page * 7 + length(category)) % 23 = 5 THEN 503 ELSE 200 END AS status, pos, id, published FROM p
"""
_STREAMED = f"""
WITH RECURSIVE shown AS MATERIALIZED ({plain(_SHOWN).replace('TIMESTAMP_NTZ', 'TIMESTAMP').replace('{cycles}', f"(SELECT CAST(unnest(range(1, {_CYCLES + 1})) AS INT) AS cycle)")}),
h AS MATERIALIZED (SELECT cycle, category, page, min(status) = 200 AS good, max(published) AS top, min(published) AS bottom FROM shown GROUP BY ALL),
cat AS (SELECT category, min(cycle) AS first FROM h GROUP BY category),
r AS (SELECT category, first - 1 AS cycle, NULL::TIMESTAMP AS mark, NULL::TIMESTAMP AS target, 1 AS resume, []::INT[] AS pages FROM cat
  UNION ALL SELECT category, cycle + 1, CASE WHEN mark IS NULL THEN newest WHEN closed THEN coalesce(newest, mark) ELSE mark END, CASE WHEN mark IS NULL OR closed THEN NULL WHEN newest IS NULL THEN target ELSE newest END,
    CASE WHEN mark IS NULL OR closed THEN 1 WHEN newest IS NULL THEN resume WHEN broken IS NOT NULL THEN greatest(2, broken) ELSE greatest(2, plan[-1] + 1) END, got
  FROM (SELECT *, list_filter(plan, lambda x: list_position(plan, x) < coalesce(list_position(plan, broken), 99) AND list_position(plan, x) <= coalesce(list_position(plan, ended), 99)) AS got,
      ended IS NOT NULL AND coalesce(list_position(plan, ended), 99) < coalesce(list_position(plan, broken), 99) AS closed, CASE WHEN resume > 1 THEN target WHEN coalesce(broken, 0) <> 1 THEN first_top END AS newest
    FROM (SELECT r.category, r.cycle, r.mark, r.target, r.resume, r.plan, min(h.page) FILTER (WHERE NOT h.good) AS broken, coalesce(min(CASE WHEN h.good AND h.bottom <= r.mark - INTERVAL 30 MINUTES THEN h.page END), 999999) AS e1, coalesce(min(CASE WHEN h.page IS NULL THEN q.x END), 999999) AS e2,
        nullif(least(e1, e2), 999999) AS ended, max(h.top) FILTER (WHERE h.page = 1) AS first_top
      FROM (SELECT *, CASE WHEN mark IS NULL THEN [1] WHEN resume > 1 THEN [1, greatest(2, resume - 1), greatest(2, resume - 1) + 1] ELSE [1, 2, 3] END AS plan FROM r WHERE cycle < {_CYCLES}) r, unnest(r.plan) q(x) LEFT JOIN h ON h.category = r.category AND h.cycle = r.cycle + 1 AND h.page = q.x
      GROUP BY r.category, r.cycle, r.mark, r.target, r.resume, r.plan)))
SELECT s.cycle, s.category, s.page, s.pos, s.id, s.published FROM r JOIN shown s ON s.category = r.category AND s.cycle = r.cycle AND list_contains(r.pages, s.page)
"""


@query(_STREAMED)
def str7_str9_src32_walk_stream(spark, sf):
    """Seven polls of all categories by a stream that stops after the fourth and goes on from its checkpoint; page 1 always, three pages a poll, and the watermark
    moves only when the gap is closed. Some pages cannot be read."""
    path = scratch(spark, "walk")
    sql = _SHOWN.replace("//", "div").replace("{cycles}", f"(SELECT CAST(id AS INT) AS cycle FROM range(1, {_CYCLES + 1}))")
    pages = bound(spark, sf, sql)
    pages = pages.withColumns({c: F.when(F.col("status") == 200, F.col(c)) for c in ("id", "published")})
    spark.dataSource.register(PageWalk)
    for part in (f"cycle <= {_TURN}", f"cycle > {_TURN}"):
        pages.where(part).write.mode("append").partitionBy("cycle").parquet(f"{path}/pages")
        read = spark.readStream.format("page_walk").option("path", f"{path}/pages").load()
        found = run_to_end(read, path)
    return found
