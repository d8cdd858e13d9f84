"""Queries over state that is kept between polls: unique keys, recent values, coverage, profiles, clean-ups, traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import texts
from brindle.operators import coverage, decisions, matching, ordered, profiles, state
from brindle.operators.stored import stored
from brindle.plans.base import L, bound, listings, plain, query, scratch, table
from brindle.plans.records import _CLS, _FACTS, _HEAD, _LABEL, _MONEY, assessed, facts, headline
from brindle.sources import pages

stamp = lambda s: F.expr(f"cast('{s}' as timestamp_ntz)")

# --- upserts under several unique keys -------------------------------------------------------------------------------

#: Rows of which some have the id of the row before, the URL of the one before that, or its fingerprint: chains of clashes, over both batches.
_SEEN = """SELECT o_orderkey AS pos, 'id' || CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS STRING) AS id, 'u' || CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 4 THEN 1 ELSE 0 END AS STRING) AS url,
  CASE WHEN o_orderkey % 7 <> 1 THEN 'f' || CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 5 THEN 1 ELSE 0 END AS STRING) END AS fingerprint, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS published, o_orderdate AS first_seen, o_orderdate AS last_seen, o_custkey % 2 AS batch FROM {orders}"""
_TIED = f"""WITH RECURSIVE r AS MATERIALIZED ({plain(_SEEN)}), k AS MATERIALIZED (SELECT pos, 'id:' || id AS key FROM r UNION SELECT pos, 'url:' || url FROM r UNION SELECT pos, 'fingerprint:' || fingerprint FROM r WHERE fingerprint IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT a.pos AS a, b.pos AS b FROM k a JOIN k b ON a.key = b.key AND a.pos <> b.pos), t AS (SELECT pos AS a, pos AS b FROM r UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b), c AS MATERIALIZED (SELECT a AS pos, min(b) AS component FROM t GROUP BY a)"""


def _folded(spark, sf) -> DataFrame:
    spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    rows = bound(spark, sf, _SEEN)
    first, second = (rows.where(f"batch = {i}").drop("batch") for i in (0, 1))
    now = first.limit(0).withColumn("aliases", F.array().cast("array<string>"))
    for batch in (first, second, second):
        now = stored(state.merged_unique(now, batch, ["id", "url", "fingerprint"], ["published"], ["first_seen"], ["last_seen"]))
    return now


@query(
    _TIED + """, f AS (SELECT component, (arg_min(row(id, url, fingerprint), r.pos)) AS keys, coalesce(arg_max(published, r.pos) FILTER (WHERE batch = 1 AND published IS NOT NULL), arg_max(published, r.pos) FILTER (WHERE published IS NOT NULL)) AS published, min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM r JOIN c ON c.pos = r.pos GROUP BY component), a AS (SELECT component, string_agg(DISTINCT key, ',' ORDER BY key) AS aliases FROM k JOIN c ON c.pos = k.pos GROUP BY component)
SELECT component AS pos, keys[1] AS id, keys[2] AS url, keys[3] AS fingerprint, published, first_seen, last_seen, aliases FROM f JOIN a USING (component)"""
)
def ups1_upsert_under_unique_keys(spark, sf):
    """Two batches folded into the seen table, the second one twice; id, URL and fingerprint are unique each, and of clashing rows the first gives the keys."""
    return _folded(spark, sf).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH r AS ({plain(_SEEN)}), s AS (SELECT * FROM r WHERE batch = 0 AND pos % 3 = 0) SELECT pos FROM r WHERE id NOT IN (SELECT id FROM s) AND url NOT IN (SELECT url FROM s) AND (fingerprint IS NULL OR fingerprint NOT IN (SELECT fingerprint FROM s WHERE fingerprint IS NOT NULL))")
def jn1_flt7_unseen_by_three_keys(spark, sf):
    """Rows that the seen table has neither by id nor by URL nor by fingerprint."""
    rows = bound(spark, sf, _SEEN)
    return matching.unseen(rows, rows.where("batch = 0 and pos % 3 = 0"), [["id"], ["url"], ["fingerprint"]]).select("pos")


# --- profiles --------------------------------------------------------------------------------------------------------

_VISITS = "SELECT l_suppkey % 40 AS seller, CASE WHEN l_partkey % 11 <> 0 THEN 'a' || CAST(l_partkey % 60 AS STRING) END AS address, l_orderkey * 10 + l_linenumber AS made FROM {lineitem}"
_MIDDLE = "SELECT max(made) / 2 AS half FROM v"


@query(
    f"WITH v AS ({plain(_VISITS)}), h AS ({_MIDDLE}), a AS (SELECT seller, address, min(made) AS made FROM v, h WHERE made <= half AND address IS NOT NULL GROUP BY seller, address QUALIFY row_number() OVER (PARTITION BY seller ORDER BY min(made) DESC, address DESC) <= {profiles.ADDRESSES}), "
    f"b AS (SELECT seller, address, min(made) AS made FROM (SELECT * FROM a UNION ALL SELECT seller, address, made FROM v, h WHERE made > half AND address IS NOT NULL) GROUP BY seller, address QUALIFY row_number() OVER (PARTITION BY seller ORDER BY min(made) DESC, address DESC) <= {profiles.ADDRESSES}) "
    "SELECT seller, string_agg(address, ',' ORDER BY made, address) AS addresses, count(*) AS n FROM b GROUP BY seller"
)
def agg4_recent_addresses(spark, sf):
    """The last eight different addresses of every seller, in order, over two polls: what the first one leaves is stored and read back."""
    rows = bound(spark, sf, _VISITS)
    half = F.lit(rows.agg(F.max("made")).first()[0] / 2)
    path, columns = scratch(spark, "addresses"), "seller bigint, address string, made bigint"
    state.recent_distinct(spark.createDataFrame([], columns), rows.where(F.col("made") <= half), "seller", "address", "made", profiles.ADDRESSES).write.parquet(path)
    last = state.recent_distinct(spark.read.schema(columns).parquet(path), rows.where(F.col("made") > half), "seller", "address", "made", profiles.ADDRESSES)
    listed = F.array_sort(F.collect_list(F.struct("made", "address")))  # eight a seller
    return last.groupBy("seller").agg(F.array_join(F.transform(listed, lambda x: x["address"]), ",").alias("addresses"), F.count("*").alias("n"))


_PROFILES = """SELECT o_orderkey AS pos, CASE o_orderkey % 2 WHEN 0 THEN 'olx' ELSE 'domria' END AS source, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS seller, o_orderkey % 13 = 0 OR o_custkey % 6 = 0 AS owner, o_custkey % 4 <> 0 AS readable,
  CASE WHEN o_orderkey % 41 = 0 THEN 2026 WHEN o_orderkey % 5 = 0 THEN 2020 END AS year, CASE WHEN o_custkey % 5 = 0 THEN o_orderdate END AS created, o_orderkey % 7 = 0 AS likely,
  CASE o_custkey % 3 WHEN 0 THEN 'reject' ELSE 'keep' END AS likely_policy, CASE o_custkey % 2 WHEN 0 THEN 'reject' ELSE 'keep' END AS new_policy FROM {orders}"""
_AT = "1995-03-01 00:00:00"


@query(
    f"""WITH p AS ({plain(_PROFILES)}), g AS (SELECT source, seller, min(owner) AS o, max(CAST(year = 2026 AS INT)) AS y, min(created) AS c, max(likely) AS l FROM p WHERE seller IS NOT NULL GROUP BY ALL),
v AS (SELECT p.*, CASE WHEN p.seller IS NULL THEN CASE WHEN owner THEN 'confirmed_owner' WHEN likely THEN 'profile_likely_intermediary' ELSE 'unknown' END WHEN y = 1 THEN 'seller_registration_year_2026' WHEN o THEN 'confirmed_owner'
  WHEN c <= TIMESTAMP '{_AT}' AND c > TIMESTAMP '{_AT}' - INTERVAL 7 DAYS THEN 'profile_high_risk' WHEN l THEN 'profile_likely_intermediary' ELSE 'unknown' END AS verdict FROM p LEFT JOIN g ON g.source = p.source AND g.seller = p.seller)
SELECT pos, verdict, owner OR CASE verdict WHEN 'seller_registration_year_2026' THEN false WHEN 'profile_likely_intermediary' THEN likely_policy = 'keep' WHEN 'profile_high_risk' THEN new_policy = 'keep' ELSE true END AS kept FROM v"""
)
def cls13_profile_policies(spark, sf):
    """Every row under its seller's profile: the excluded year, owners, young accounts, likely intermediaries, profiles that cannot be read; what the policies keep."""
    found = profiles.profile_gate(bound(spark, sf, _PROFILES), stamp(_AT), F.col("likely_policy"), F.col("new_policy"))
    return found.select("pos", "verdict", "kept")


# --- coverage --------------------------------------------------------------------------------------------------------

_SCANS = """SELECT g, CAST((n - 1) // 4 AS INT) AS cycle, CASE (n - 1) % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'hot' WHEN 2 THEN 'private' ELSE 'houses' END AS scan, TIMESTAMP_NTZ '2024-01-01 00:00:00' + ((n - 1) // 4) * (7 + g) * INTERVAL 1 MINUTE AS made,
  k % 3 <> 0 OR (n - 1) % 4 <> 0 AS ran, k % 17 <> 0 AS complete, k % 19 <> 0 AS healthy, CAST(k % 30 AS INT) AS pages, k % 4 <> 0 AS ended, CAST(k % 3 AS INT) AS novel, CAST(k % 500 AS INT) * 1000 AS elapsed, CAST(k % 11 AS INT) * 1000 AS nav
  FROM (SELECT o_custkey % 20 AS g, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS n, o_orderkey AS k FROM {orders})"""
_SCANS_DUCK = plain(_SCANS).replace("TIMESTAMP_NTZ", "TIMESTAMP")
_SCANS_SPARK = _SCANS.replace("//", "div")


@query(
    f"""WITH s AS ({_SCANS_DUCK}), c AS (SELECT g, cycle, max(made) AS t, bool_or(scan = 'full' AND ran) AND bool_and(NOT ran OR (complete AND healthy)) AS whole, bool_or(ran AND NOT (complete AND healthy)) AS troubled FROM s GROUP BY g, cycle),
a AS (SELECT c.*, p.t AS before, CASE WHEN c.whole THEN c.t ELSE p.t END AS last FROM c ASOF LEFT JOIN (SELECT g, t FROM c WHERE whole) p ON p.g = c.g AND p.t < c.t)
SELECT g, cycle, before IS NULL OR t - before >= INTERVAL 30 MINUTES AS due, whole AS committed, last AS committed_at, epoch(t - last) / 60.0 AS age_minutes, last IS NULL OR t - last > INTERVAL 30 MINUTES AS degraded, last IS NULL OR t - last >= INTERVAL 60 MINUTES AS unsafe,
  troubled OR last IS NULL OR t - last > INTERVAL 30 MINUTES AS truncated FROM a"""
)
def str13_str28_snapshots_as_of(spark, sf):
    """Cycles of four scans against the last whole snapshot: when a full scan is due, what is committed, and how old coverage is."""
    found = coverage.as_of_snapshots(coverage.cycles(bound(spark, sf, _SCANS_SPARK).withColumnRenamed("made", "at"), "g"), "g")
    return found.withColumn("committed_at", F.col("committed_at").cast("timestamp_ntz"))


@query(
    f"""WITH s AS ({_SCANS_DUCK}), w AS (SELECT g, cycle, max(pages) FILTER (WHERE scan = 'full') AS ap, coalesce(bool_and(ended) FILTER (WHERE scan = 'full'), false) AS ae, max(novel) FILTER (WHERE scan = 'full') AS an, max(pages) FILTER (WHERE scan = 'houses') AS hp, coalesce(bool_and(ended) FILTER (WHERE scan = 'houses'), false) AS he, sum(elapsed) AS el, max(nav) AS nav FROM s GROUP BY g, cycle)
SELECT g, cycle, concat_ws(',', CASE WHEN NOT ae THEN 'apartments_end_unknown' || CASE WHEN ap >= 25 THEN ',apartments_hit_page_cap_still_novel' ELSE '' END || CASE WHEN an > 0 THEN ',apartments_last_page_still_had_novel_ids' ELSE '' END END, CASE WHEN NOT he THEN 'houses_end_unknown' END,
  CASE WHEN el > 400000 THEN 'elapsed_exceeds_olx_total_budget' END, CASE WHEN el > 300000 THEN 'elapsed_exceeds_half_poll_cycle' END, CASE WHEN ae AND nav > 0 AND (ap + coalesce(hp, 0)) * nav > 400000 THEN 'projected_nav_time_exceeds_olx_total_budget' END) AS reasons FROM w"""
)
def str17_scan_feasibility(spark, sf):
    """Why each cycle's full scans do not prove coverage, all reasons in order; none where they do."""
    of = lambda f, c, scan: f(F.when(F.col("scan") == scan, F.col(c)))
    rows = bound(spark, sf, _SCANS_SPARK).groupBy("g", "cycle").agg(
        of(F.max, "pages", "full").alias("ap"), F.coalesce(of(F.bool_and, "ended", "full"), F.lit(False)).alias("ae"), of(F.max, "novel", "full").alias("an"), F.coalesce(of(F.max, "pages", "houses"), F.lit(0)).alias("hp"),
        F.coalesce(of(F.bool_and, "ended", "houses"), F.lit(False)).alias("he"), F.sum("elapsed").alias("el"), F.max("nav").alias("nav"),
    )
    reasons = coverage.block_reasons(*(F.col(c) for c in ("ap", "ae", "an", "hp", "he", "el", "nav")), 400_000, 600_000)
    return rows.select("g", "cycle", F.array_join(reasons, ",").alias("reasons"))


# --- clean-ups -------------------------------------------------------------------------------------------------------

_KEPT = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'outbox' WHEN 'view' THEN 'verdicts' WHEN 'error' THEN 'holds' WHEN 'purchase' THEN 'profiles' ELSE 'traces' END AS kind, CASE WHEN event_id % 29 <> 0 THEN ts END AS made, CASE event_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'pending' ELSE 'failed' END AS status FROM {events}"""
_CLEANUPS = [("2024-01-20 00:00:00", None), ("2024-01-20 18:00:00", "2024-01-20 00:00:00"), ("2024-02-10 00:00:00", "2024-01-20 00:00:00"), ("2024-04-20 00:00:00", "2024-02-10 00:00:00")]
_DAYS = "CASE kind WHEN 'outbox' THEN 30 WHEN 'verdicts' THEN 0 WHEN 'holds' THEN 1 WHEN 'profiles' THEN 90 ELSE 14 END"


@query(
    f"WITH k AS ({plain(_KEPT)}), c AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-20'), (2, TIMESTAMP '2024-02-10'), (3, TIMESTAMP '2024-04-20')) c(i, t)), g AS (SELECT id, kind, min(i) AS gone FROM k, c WHERE made < t - {_DAYS} * INTERVAL 1 DAY AND (kind <> 'outbox' OR status = 'sent') GROUP BY ALL) "
    "SELECT i.i AS cleanup, k.kind, count(*) FILTER (WHERE g.gone IS NULL OR g.gone > i.i) AS kept FROM (SELECT unnest([0, 1, 2, 3]) AS i) i, k LEFT JOIN g USING (id, kind) GROUP BY ALL"
)
def ups16_five_rules_once_a_day(spark, sf):
    """Four clean-ups one after the other, the second too early to do anything: rows of each table that stay. Undated and unsent rows always do."""
    rows = bound(spark, sf, _KEPT).withColumnRenamed("made", "at")
    tables = {k: rows.where(F.col("kind") == k) for k in state.RETENTION_DAYS}
    found = []
    for i, (now, last) in enumerate(_CLEANUPS):
        tables = state.cleaned(tables, stamp(now), stamp(last) if last else F.lit(None).cast("timestamp_ntz"))
        found += [df.agg(F.count("*").alias("kept")).select(F.lit(i).alias("cleanup"), F.lit(k).alias("kind"), "kept") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, found)


# --- traces ----------------------------------------------------------------------------------------------------------

_TRACES = "SELECT event_id AS pos, 's' || CAST(user_id % 4 AS STRING) AS source, CAST(user_id % 4 * 1000 + (event_id // 2) % (6 + user_id % 4 * 40) AS STRING) AS source_id, CASE event_type WHEN 'error' THEN 'queued' WHEN 'purchase' THEN 'delivered' ELSE 'deduped' END AS stage, event_type IN ('error', 'purchase') AS first FROM {events}"
_CAP = 300


@query(
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, source || '|' || source_id || '|' || stage AS key FROM ({plain(_TRACES)})),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn FROM t WHERE first),
p AS (SELECT 0::BIGINT AS turn, []::VARCHAR[] AS kept, []::BIGINT[] AS rows, true AS going UNION ALL
  SELECT turn, list_concat(kept, list_slice(fresh_keys, 1, {_CAP} - len(kept))), list_concat(rows, list_slice(fresh_rows, 1, {_CAP} - len(rows))), len(fresh_keys) > 0
  FROM (SELECT p.turn + 1 AS turn, any_value(p.kept) AS kept, any_value(p.rows) AS rows, coalesce(list(a.key ORDER BY a.source) FILTER (WHERE NOT list_contains(p.kept, a.key)), []) AS fresh_keys, coalesce(list(a.pos ORDER BY a.source) FILTER (WHERE NOT list_contains(p.kept, a.key)), []) AS fresh_rows
    FROM p LEFT JOIN a ON a.turn = p.turn + 1 WHERE p.going AND len(p.kept) < {_CAP} GROUP BY p.turn)),
e1 AS (SELECT max(turn) AS turn, arg_max(kept, turn) AS kept, arg_max(rows, turn) AS rows FROM p),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn FROM (SELECT pos, source, key FROM t WHERE NOT first UNION ALL SELECT a.pos, a.source, a.key FROM a, e1 WHERE a.turn > e1.turn)),
q AS (SELECT 0::BIGINT AS turn, kept, rows, true AS going FROM e1 UNION ALL
  SELECT turn, list_concat(kept, list_slice(fresh_keys, 1, {_CAP} - len(kept))), list_concat(rows, list_slice(fresh_rows, 1, {_CAP} - len(rows))), len(fresh_keys) > 0
  FROM (SELECT q.turn + 1 AS turn, any_value(q.kept) AS kept, any_value(q.rows) AS rows, coalesce(list(b.key ORDER BY b.source) FILTER (WHERE NOT list_contains(q.kept, b.key)), []) AS fresh_keys, coalesce(list(b.pos ORDER BY b.source) FILTER (WHERE NOT list_contains(q.kept, b.key)), []) AS fresh_rows
    FROM q LEFT JOIN b ON b.turn = q.turn + 1 WHERE q.going AND len(q.kept) < {_CAP} GROUP BY q.turn)),
f AS (SELECT arg_max(rows, len(rows)) AS rows FROM q)
SELECT unnest(rows) AS pos, CAST(unnest(range(1, len(rows) + 1)) AS INT) AS rank FROM f"""
)
def win4_trace_selection(spark, sf):
    """Traces over the cap: those on the way to delivery first, a row a source and pass; duplicates are used up, and a pass of nothing but duplicates ends a phase."""
    spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    rows = bound(spark, sf, _TRACES.replace("//", "div"))
    return ordered.consuming_round_robin(rows, "first", "source", "pos", ["source", "source_id", "stage"], _CAP).select("pos", "rank")


# --- messages --------------------------------------------------------------------------------------------------------

_CUT = 400


@query(
    f"""WITH RECURSIVE r AS (SELECT doc_id, 0 AS n, text AS rest, NULL::VARCHAR AS part FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, n + 1, CASE WHEN length(rest) <= {_CUT} THEN NULL ELSE regexp_replace(rest[cut + 1:], '^\n', '') END, CASE WHEN length(rest) <= {_CUT} THEN rest ELSE rest[1:cut] END
  FROM (SELECT *, CASE WHEN line IS NULL OR line < {_CUT // 2} THEN {_CUT} ELSE line END AS cut FROM (SELECT *, {_CUT + 1} - nullif(strpos(reverse(rest[1:{_CUT + 1}]), chr(10)), 0) AS line FROM r WHERE rest IS NOT NULL AND (rest <> '' OR n = 0))))
SELECT doc_id, count(*) AS n_parts, md5(string_agg(part, chr(1) ORDER BY n)) AS parts_md5 FROM r WHERE n > 0 GROUP BY doc_id"""
)
def snk4_split_message(spark, sf):
    """Texts in parts that a message holds, cut at line breaks where that leaves at least half."""
    parts = table(spark, sf, "documents").where("text is not null").select("doc_id", texts.split_message(F.col("text"), _CUT).alias("parts"))
    return parts.select("doc_id", F.size("parts").cast("bigint").alias("n_parts"), F.md5(F.array_join("parts", "\u0001")).alias("parts_md5"))


_SHIFTED = "(published_at + INTERVAL 25 YEARS + (pos % 1440) * INTERVAL 1 MINUTE)"
_NOWS = f"({_SHIFTED} + (pos % 4) * INTERVAL 9 HOURS)"
#: Clocks go forward at 1 o'clock UTC on the last Sunday of March and back on that of October.
_SUNDAY = lambda t, m: f"(make_date(year({t}), {m}, 31) - CAST(dayofweek(make_date(year({t}), {m}, 31)) AS INT) + INTERVAL 1 HOUR)"
_LOCAL = lambda t: f"({t} + CASE WHEN {t} >= {_SUNDAY(t, 3)} AND {t} < {_SUNDAY(t, 10)} THEN INTERVAL 3 HOURS ELSE INTERVAL 2 HOURS END)"
_DAY = lambda t: f"(year({t}) * 372 + month({t}) * 31 + day({t}))"
_SAID = f"""CASE WHEN {_DAY('here')} = {_DAY('there')} THEN 'сьогодні' WHEN {_DAY('here')} = {_DAY('there')} - 1 THEN 'вчора' ELSE CAST(day(here) AS VARCHAR) || ' ' || ({texts.MONTHS!r})[month(here)] END || ', ' || strftime(here, '%H:%M')"""
_DATED = f"l2 AS (SELECT *, {_LOCAL('p')} AS here, {_LOCAL('q')} AS there FROM (SELECT *, {_SHIFTED} AS p, {_NOWS} AS q FROM {{src}}))"


@query(L + "," + _DATED.replace("{src}", "l") + f" SELECT pos, {_SAID} AS label FROM l2 WHERE published_at IS NOT NULL")
def fn17_zone_label(spark, sf):
    """Dates as they are shown in a zone with summer time, against a now of the same to the next day."""
    rows = listings(spark, sf).where("published_at is not null").withColumns({"p": F.expr(_SHIFTED), "q": F.expr(_NOWS)})
    return rows.select("pos", texts.local_label(F.col("p"), F.col("q")).alias("label"))


_ESCAPED = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SITE = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.SITES.items()) + " END"
_OWNER = "CASE WHEN seller_type = 'owner' AND level = 'platform_confirmed' THEN '{0}' ELSE '{1}' END"
_HTML = (
    f"'🏠 <b>' || {_HEAD} || '</b>' || chr(10) || chr(10) || '💰 <b>' || {_LABEL} || '</b>' || chr(10) || '📐 ' || {_FACTS} || chr(10) || '👤 ' || {_OWNER.format(texts.CONFIRMED[0], texts.UNCONFIRMED[0])} || chr(10) || '🛡 ' || {_OWNER.format(texts.CONFIRMED[1], texts.UNCONFIRMED[1])} || chr(10) || chr(10) || '🕒 ' || "
    f"coalesce('Опубліковано: ' || {_SAID}, '{texts.UNDATED}') || chr(10) || '🌐 ' || {_SITE} || chr(10) || chr(10) || '🔗 <a href=\"' || {_ESCAPED('url || seller_mark')} || '\">{texts.LINK}</a>'"
)


@query(
    L + "," + _MONEY + "," + _CLS.replace("{src}", "f") + "," + _DATED.replace("{src}", "(SELECT *, CASE WHEN pos % 6 = 0 THEN '?a=1&b=<2>' ELSE '' END AS seller_mark FROM rj)")
    + f", msg AS (SELECT pos, {_HTML} AS html FROM l2) SELECT pos, html, regexp_replace(replace(replace(html, '<b>', ''), '</b>', ''), '<a href=\"([^\"]*)\">([^<]*)</a>', '\\2 \\1', 'g') AS plain FROM msg"
)
def snk3_fn19_html_message(spark, sf):
    """Messages in HTML with the seller's lines and the local date, and without markup."""
    rows = assessed(listings(spark, sf)).withColumns({"p": F.expr(_SHIFTED), "q": F.expr(_NOWS), "link": F.concat("url", F.expr("if(pos % 6 = 0, '?a=1&b=<2>', '')"))})
    confirmed = F.expr("seller_type = 'owner' and level = 'platform_confirmed'")
    c = F.col
    html = texts.html_message(headline(c("property_type"), c("rooms")), texts.price_label(c("amount"), c("currency"), c("period")), facts(c("area"), c("rooms")), confirmed, c("p"), c("q"), c("source"), c("link"))
    return rows.select("pos", html.alias("html")).withColumn("plain", texts.plain_message(F.col("html")))


# --- counters and batches ----------------------------------------------------------------------------------------------

_SAYS = {where: f"CASE o_orderkey % {m} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(decisions.COUNTERS[where][: 10 if where == "detail" else None])) + " END" for where, m in (("same_cycle", 17), ("cache", 13), ("detail", 10))}
_LINKED = f"SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS cycle, o_orderkey % 4 <> 0 AS target, {_SAYS['same_cycle']} AS peer, {_SAYS['cache']} AS cached, {_SAYS['detail']} AS detail FROM {{orders}}"
_NAMES = [f"{where}_{v}" for where, verdicts in decisions.COUNTERS.items() for v in verdicts]
_CAP_CHECKS = 3


@query(
    f"""WITH c AS ({plain(_LINKED)}), n AS (SELECT *, target AND peer IS NULL AND cached IS NULL AS needs FROM c), r AS (SELECT *, count(*) FILTER (WHERE needs) OVER (PARTITION BY cycle ORDER BY id) AS place, count(*) FILTER (WHERE needs AND detail = 'rate_limited') OVER (PARTITION BY cycle ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS halted FROM n),
o AS (SELECT CASE WHEN NOT target THEN 'not_required' WHEN peer IS NOT NULL THEN 'same_cycle_' || peer WHEN cached IS NOT NULL THEN 'cache_' || cached WHEN halted THEN 'skipped_after_rate_limit' WHEN place > {_CAP_CHECKS} THEN 'detail_capacity_deferred' ELSE 'detail_' || detail END AS counter, needs AND NOT halted AND place <= {_CAP_CHECKS} AS asked FROM r),
k AS (SELECT unnest({_NAMES!r}) AS counter) SELECT k.counter, count(o.counter) AS n FROM k LEFT JOIN o ON o.counter = k.counter GROUP BY k.counter UNION ALL SELECT 'detail_requests', count(*) FILTER (WHERE asked) FROM o"""
)
def agg24_verification_counters(spark, sf):
    """All counters of linked sellers' verification over all cycles, those that nothing came to as well, and the requests made."""
    needs = F.expr("target and peer is null and cached is null")
    upto = Window.partitionBy("cycle").orderBy("id")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = bound(spark, sf, _LINKED).withColumn("place", F.count_if(needs).over(upto)).withColumn("halted", F.coalesce(F.count_if(needs & (F.col("detail") == "rate_limited")).over(before) > 0, F.lit(False)))
    counter = decisions.verification_counter(F.col("target"), F.col("peer"), F.col("cached"), F.col("halted"), F.col("place"), _CAP_CHECKS, F.col("detail"))
    asked = needs & ~F.col("halted") & (F.col("place") <= _CAP_CHECKS)
    sums = rows.withColumn("counter", counter).agg(*(F.count_if(F.col("counter") == n).alias(n) for n in _NAMES), F.count_if(asked).alias("detail_requests"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in sums.columns))).alias("c")).select("c.*")


_OFFERS = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"title":"no id"}' ELSE '{"id":"' || CAST(event_id // 3 AS STRING) || '","title":"T' || event_type || '"}' END AS raw FROM {events}"""


@query("WITH o AS (SELECT event_id, event_id % 7 = 0 AS bad, CAST(event_id // 3 AS STRING) AS id FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY bad, id ORDER BY event_id) AS k FROM o) SELECT event_id, CASE WHEN bad THEN 'no_id' WHEN k > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM f")
def src5_batch_with_duplicates(spark, sf):
    """A batch of offers: rejected with their reason, and of those that are accepted the first of each id."""
    rows = pages.parsed_offers(bound(spark, sf, _OFFERS.replace("//", "div")), "raw").select("event_id", "offer.id", "reject_reason")
    good = rows.where("reject_reason is null")
    first = good.groupBy("id").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(True).alias("first"))
    told = F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(F.col("first"), "accepted").otherwise("duplicate")
    return rows.join(first, "event_id", "left").select("event_id", told.alias("outcome"))
