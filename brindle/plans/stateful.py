"""Queries over state: upserts, status folds, retention, walks over pages, and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.operators import decisions, ordered, state
from brindle.operators.freshness import crossed_boundary
from brindle.plans.base import L, NOW, ORACLE_SQL, bound, listings, plain, query, scratch, table
from brindle.plans.records import U
from brindle.streaming import stateful

stamp = lambda s: F.expr(f"cast('{s}' as timestamp_ntz)")
n_if = lambda e: F.count_if(F.expr(e))

# --- upserts and transitions -----------------------------------------------------------------------------------------

_SPLIT = "SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM {events}"
_MERGED = f"""
WITH e AS ({plain(_SPLIT)}), o AS (SELECT user_id, arg_max(value, row(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, min(ts) AS first_seen, max(ts) AS last_seen FROM e WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 4 <> 0 GROUP BY user_id),
n AS (SELECT user_id, arg_max(value, row(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, min(ts) AS first_seen, max(ts) AS last_seen FROM e WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY user_id)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.value, o.value) AS value, coalesce(least(n.first_seen, o.first_seen), n.first_seen, o.first_seen) AS first_seen, coalesce(greatest(n.last_seen, o.last_seen), n.last_seen, o.last_seen) AS last_seen FROM n FULL JOIN o ON n.user_id = o.user_id
"""


def _folded(df):
    return df.groupBy("user_id").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("value"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query(_MERGED)
def ups1_ups2_ups4_seen_upsert(spark, sf):
    """New non-null values win, first_seen never moves forward, last_seen never back; a second fold changes nothing."""
    rows = bound(spark, sf, _SPLIT)
    old = _folded(rows.where(F.col("ts") < stamp("2024-01-20")).where("user_id % 4 <> 0"))
    batch = rows.where(F.col("ts") >= stamp("2024-01-20")).withColumn("first_seen", F.col("ts")).withColumn("last_seen", F.col("ts"))
    fold = lambda s: state.merged(s, batch, ["user_id"], ["value"], ["first_seen"], ["last_seen"], ["ts", "event_id"])
    return fold(fold(old))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT user_id, event_type, min(event_id) FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 2 = 0 AND x.user_id = e.user_id AND x.event_type = e.event_type) GROUP BY ALL")
def ups3_ups8_insert_or_ignore(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    first = ordered.keep_first(rows.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"])
    return state.inserted_or_ignored(first, rows.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id % 5 AS source, min(ts) AS established, max(CASE WHEN event_type <> 'error' THEN ts END) AS last_success FROM events GROUP BY 1")
def ups5_ups12_ups15_baselines(spark, sf):
    """The first poll establishes a source, later ones only move its last success."""
    return table(spark, sf, "events").groupBy(F.expr("user_id % 5").alias("source")).agg(F.min("ts").alias("established"), F.max(F.when(F.expr("event_type <> 'error'"), F.col("ts"))).alias("last_success"))


_RUNS = "WITH e AS (SELECT user_id % 5 AS source, ts, event_id, event_type = 'error' AS bad FROM events WHERE event_type <> 'view'), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) "


@query("WITH e AS (SELECT user_id % 5 AS source, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'view'), l AS (SELECT source, coalesce(max(CASE WHEN ok THEN n END), 0) AS last_ok FROM e GROUP BY source) SELECT e.source, count(*) FILTER (WHERE n > last_ok) AS consecutive_failures, count(*) AS n_attempts FROM e JOIN l USING (source) GROUP BY e.source")
def ups6_health_fold(spark, sf):
    rows = table(spark, sf, "events").withColumn("source", F.expr("user_id % 5"))
    return state.health_fold(rows, "source", ["ts", "event_id"], F.expr("event_type <> 'error'"), F.expr("event_type = 'view'"))


@query(_RUNS + ", s AS (SELECT source, run, count(*) FILTER (WHERE bad) AS n FROM g GROUP BY ALL), m AS (SELECT source, max(run) AS last FROM g GROUP BY source) SELECT m.source, count(*) FILTER (WHERE n >= 3) AS opened, count(*) FILTER (WHERE n >= 3 AND run < last) AS recovered FROM s JOIN m USING (source) GROUP BY m.source")
def ups14_incidents(spark, sf):
    rows = table(spark, sf, "events").where("event_type <> 'view'").withColumn("source", F.expr("user_id % 5"))
    return state.incidents(rows.withColumn("day", F.to_date("ts")), "source", "day", ["ts", "event_id"], F.expr("event_type = 'error'"))


_HOLDS = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'defer' ELSE 'allow' END AS decision, o_orderdate + INTERVAL 20 MINUTES AS deadline, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 20 MINUTES ELSE o_orderdate + INTERVAL 19 MINUTES END AS now FROM {orders}"


@query(f"WITH h AS ({plain(_HOLDS)}) SELECT id, CASE WHEN decision = 'reject' THEN 'drop' WHEN decision = 'defer' AND now < deadline THEN 'keep' WHEN decision = 'defer' THEN 'drop' ELSE 'send' END AS action FROM h")
def ups9_hold_resolution(spark, sf):
    return bound(spark, sf, _HOLDS).select("id", state.hold_action(F.col("decision"), F.col("now"), F.col("deadline")).alias("action"))


_NEXT = "CASE WHEN s IN ('pending', 'failed') AND event_type = 'click' THEN 'sending' WHEN s = 'sending' AND event_type = 'purchase' THEN 'sent' WHEN s = 'sending' AND event_type = 'error' THEN 'failed' ELSE s END"


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS s FROM e UNION ALL "
    f"SELECT f.user_id, e.n, {_NEXT.replace('event_type', 'e.event_type')} FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1), m AS (SELECT user_id, max(n) AS n FROM f GROUP BY user_id) SELECT f.user_id, CASE WHEN s = 'sending' THEN 'pending' ELSE s END AS status, f.n AS n_events FROM f JOIN m USING (user_id, n)"
)
def ups10_ups11_outbox_transitions(spark, sf):
    """Events folded per id in order; transitions that do not apply are ignored; what was being sent at the end is pending again."""
    moves = {("pending", "click"): "sending", ("failed", "click"): "sending", ("sending", "purchase"): "sent", ("sending", "error"): "failed"}
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    folded = state.folded_transitions(rows, "user_id", "day", ["ts", "event_id"], "event_type", ["pending", "sending", "sent", "failed"], moves)
    final = F.col("by_state")["pending"]
    return folded.select("user_id", F.when(final == "sending", "pending").otherwise(final).alias("status"), F.col("n").alias("n_events"))


@query("SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS kept, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS removed FROM events GROUP BY event_type")
def ups16_retention(spark, sf):
    rows = table(spark, sf, "events")
    kept = state.retained(rows, "ts", stamp("2024-01-10")).groupBy("event_type").agg(F.count("*").alias("kept"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).join(kept, "event_type", "left").select("event_type", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


#: Rows of a table as three versions of its schema had them, with what each had; `v` tells which.
_OLD = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, CASE c_mktsegment WHEN 'BUILDING' THEN 'sent' WHEN 'MACHINERY' THEN 'failed' ELSE 'pending' END AS state, c_custkey % 3 AS v FROM {customer}"


@query(
    f"WITH o AS ({plain(_OLD)}) SELECT k AS id, name, CASE WHEN v = 0 THEN 'pending' ELSE state END AS status, CASE WHEN v = 2 THEN CAST(floor(balance) AS BIGINT) ELSE 0 END AS attempts, CASE WHEN v = 0 THEN 'v1' ELSE 'v2' END AS origin, 3 AS version FROM o "
    "UNION ALL SELECT -1, 'ledger', 'pending', count(DISTINCT v), 'v2', 3 FROM o"
)
def ups17_migration(spark, sf):
    """Tables of three schema versions brought to the last, step by step: columns renamed, added and widened, every row kept; steps already taken are not taken again."""
    rows = bound(spark, sf, _OLD)
    first = rows.where("v = 0").selectExpr("k as customer", "name as label")
    second = rows.where("v = 1").selectExpr("k as id", "name", "state as status", "'v2' as origin")
    third = rows.where("v = 2").selectExpr("k as id", "name", "state as status", "'v2' as origin", "cast(floor(balance) as bigint) as attempts")
    moved = [state.migrated(d, version, state.MIGRATIONS) for version, d in enumerate((first, second, third), 1)]
    done = reduce(lambda a, b: a.unionByName(b), moved)
    ledger = spark.createDataFrame([(-1, "ledger", "pending", "v2", len(state.MIGRATIONS) + 1)], "id bigint, name string, status string, origin string, attempts bigint")
    return done.unionByName(ledger).withColumn("version", F.lit(len(state.MIGRATIONS) + 1))


_REJECTS = "SELECT o_orderkey AS id, o_custkey % 5 AS channel, o_orderdate AS at, o_orderkey % 3 = 0 AS rejected, o_orderkey % 4 <> 1 AS held, o_orderkey % 10 = 0 AS dry FROM {orders}"


@query(
    f"WITH r AS ({plain(_REJECTS)}) SELECT id, held AND NOT (rejected AND NOT dry) AS held, rejected AND NOT dry AS seen FROM r"
)
def ups18_ups19_terminal_rejects(spark, sf):
    """A terminal reject leaves the holds and is marked as seen; a dry run changes neither table. The tables are the operators' own: no restart is survived."""
    rows = bound(spark, sf, _REJECTS)
    holds, seen = rows.where("held").select("id"), rows.where("false").select("id")
    for dry in (True, False):
        batch = rows.where(F.col("rejected") & (F.col("dry") == dry)).select("id")
        holds, seen = state.terminally_rejected(holds, seen, batch, dry)
    either = rows.select("id").join(holds.withColumn("held", F.lit(True)), "id", "left").join(seen.withColumn("seen", F.lit(True)), "id", "left")
    return either.na.fill(False)


_FAILURES = "SELECT user_id % 7 AS channel, ts, event_id, event_type = 'error' AS failed FROM {events} WHERE event_type IN ('error', 'purchase')"


@query(
    f"WITH f AS ({plain(_FAILURES)}), n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, event_id DESC) AS back FROM f), l AS (SELECT channel, coalesce(min(back) FILTER (WHERE NOT failed), count(*) + 1) - 1 AS failures, max(ts) AS last FROM n GROUP BY channel) "
    "SELECT channel, failures, CASE WHEN failures > 0 THEN last + to_seconds(least(6 * 3600, 600 * pow(2, least(8, failures - 1)))) END AS until, failures > 0 AND last + to_seconds(least(6 * 3600, 600 * pow(2, least(8, failures - 1)))) > TIMESTAMP '2024-01-31 12:00:00' AS active FROM l"
)
def ups13_channel_pause(spark, sf):
    """Each failure of a channel sets a longer pause, a success clears it; a pause holds until its time."""
    paused = state.channel_pauses(bound(spark, sf, _FAILURES), "channel", ["ts", "event_id"], F.col("failed"))
    until = F.when(F.col("failures") > 0, F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay_ms") / 1000))
    return paused.select("channel", "failures", until.alias("until")).withColumn("active", F.coalesce(F.col("until") > stamp("2024-01-31 12:00:00"), F.lit(False)))


# --- walks over pages ------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT event_type, event_id, ts, coalesce(sum(CASE WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM events) SELECT event_type, event_id FROM r WHERE hits = 0")
def str6_str9_stop_at_boundary(spark, sf):
    """Newest first, up to and with the row that crosses the watermark less its overlap."""
    rows = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return ordered.until_crossed(rows, "event_type", ["ts", "event_id"], crossed_boundary(F.col("ts"), stamp("2024-01-15"), F.expr("interval 30 minutes"))).drop("ts")


_PLAN = "SELECT s_suppkey AS id, s_suppkey % 3 <> 0 AS has_boundary, s_suppkey % 4 = 1 AS has_target, CASE WHEN s_suppkey % 4 = 1 THEN CAST(s_suppkey % 7 AS INT) END AS resume FROM {supplier}"


@query(
    f"WITH p AS ({plain(_PLAN)}) SELECT id, CASE WHEN NOT has_boundary AND NOT has_target THEN 'seed' WHEN coalesce(resume, 1) > 1 OR has_target THEN 'catchup' ELSE 'steady' END AS mode, "
    "CASE WHEN NOT has_boundary AND NOT has_target THEN '1' WHEN coalesce(resume, 1) > 1 THEN '1,' || CAST(greatest(2, resume - 1) AS STRING) || ',' || CAST(greatest(2, resume - 1) + 1 AS STRING) ELSE '1,2,3' END AS pages FROM p"
)
def str7_str16_walk_plan(spark, sf):
    """Which pages to read: one to begin with, the page budget when up to date, and page 1 besides the backlog when behind."""
    budget = 3
    seed, behind = F.expr("not has_boundary and not has_target"), F.coalesce("resume", F.lit(1)) > 1
    start = F.greatest(F.lit(2), F.col("resume") - 1)
    pages = F.when(seed, F.array(F.lit(1))).when(behind, F.concat(F.array(F.lit(1)), F.sequence(start, start + budget - 2))).otherwise(F.sequence(F.lit(1), F.lit(budget)))
    mode = F.when(seed, "seed").when(behind | F.col("has_target"), "catchup").otherwise("steady")
    return bound(spark, sf, _PLAN).select("id", mode.alias("mode"), F.array_join(pages.cast("array<string>"), ",").alias("pages"))


_WALKS = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'seed' WHEN 1 THEN 'catchup' ELSE 'steady' END AS mode, o_orderkey % 5 = 0 AS failed, o_orderkey % 3 = 0 AS crossed, o_orderkey % 11 = 0 AS ended, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS newest, CAST(o_orderkey % 4 AS INT) AS n_fetched,
  CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '{"target":"never","resumePage":2}' WHEN 2 THEN '{"target":"2024-01-01T00:00:00.000Z","resumePage":0}' WHEN 3 THEN '{broken' WHEN 4 THEN '{"target":"2024-01-01T00:00:00.000Z","resumePage":1.5}' ELSE '{"target":"2024-01-02T03:04:05.000Z","resumePage":4}' END AS stored FROM {orders}"""


@query(
    f"WITH w AS (SELECT *, id % 8 >= 5 AS kept FROM ({plain(_WALKS)})), r AS (SELECT *, failed IS FALSE AND CASE WHEN mode = 'seed' THEN newest IS NOT NULL ELSE crossed OR ended END AS reached FROM w) "
    "SELECT id, reached, CASE WHEN reached THEN newest END AS committed, CASE WHEN kept AND mode <> 'seed' AND NOT reached THEN '{\"target\":\"2024-01-02T03:04:05.000Z\",\"resumePage\":' || CAST(CASE WHEN NOT failed THEN greatest([0, 1, 4, 5][n_fetched + 1], 1) + 1 WHEN n_fetched >= 3 THEN 1 ELSE [1, 4, 5][n_fetched + 1] END AS STRING) || '}' END AS stored FROM r"
)
def str8_str18_walk_outcome(spark, sf):
    """Walks over pages 1, 4 and 5, as far as they came: what they commit, and the cursor that is stored, read back from what was stored before."""
    planned = F.array(F.lit(1), F.lit(4), F.lit(5))
    rows = bound(spark, sf, _WALKS).withColumn("cursor", decisions.cursor(F.col("stored"))).withColumn("fetched", F.slice(planned, F.lit(1), F.col("n_fetched")))
    made = decisions.walk_outcome(F.col("mode"), planned, F.col("fetched"), F.col("crossed"), F.col("failed"), F.col("ended"), F.col("newest"), F.col("cursor.target"))
    rows = rows.withColumn("w", made)
    return rows.select("id", "w.reached", "w.committed", F.when(F.col("w.resume_page").isNotNull(), decisions.cursor_text(F.col("cursor.target"), F.col("w.resume_page"))).alias("stored"))


_WALK = "SELECT l_linenumber AS page, l_partkey AS id, l_returnflag AS category FROM {lineitem}"


@query(f"WITH w AS ({plain(_WALK)}), f AS (SELECT category, id, min(page) AS first FROM w GROUP BY ALL), n AS (SELECT category, first AS page, count(*) AS n_new FROM f GROUP BY ALL), t AS (SELECT category, count(*) AS declared FROM f GROUP BY category) SELECT category, page, CAST(sum(n_new) OVER (PARTITION BY category ORDER BY page) AS BIGINT) AS n_so_far, declared, sum(n_new) OVER (PARTITION BY category ORDER BY page) >= declared AS complete FROM n JOIN t USING (category)")
def str10_str12_str13_coverage(spark, sf):
    """Different ids found up to each page against the declared total."""
    first = bound(spark, sf, _WALK).groupBy("category", "id").agg(F.min("page").alias("page"))
    so_far = F.sum("n_new").over(Window.partitionBy("category").orderBy("page"))
    total = first.groupBy("category").agg(F.count("*").alias("declared"))
    return first.groupBy("category", "page").agg(F.count("*").alias("n_new")).withColumn("n_so_far", so_far).drop("n_new").join(total, "category").withColumn("complete", F.expr("n_so_far >= declared"))


@query("WITH p AS (SELECT l_orderkey AS walk, l_linenumber AS page, string_agg(DISTINCT CAST(l_suppkey % 3 AS STRING), ',' ORDER BY CAST(l_suppkey % 3 AS STRING)) AS ids FROM lineitem GROUP BY ALL) SELECT walk, page, coalesce(ids = lag(ids) OVER (PARTITION BY walk ORDER BY page), false) AS repeated FROM p")
def str11_repeated_page(spark, sf):
    """A page that has the same set of ids as the one before."""
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("walk"), F.col("l_linenumber").alias("page")).agg(F.array_join(F.array_sort(F.collect_set(F.expr("cast(l_suppkey % 3 as string)"))), ",").alias("ids"))
    return pages.select("walk", "page", F.coalesce(F.col("ids") == F.lag("ids").over(Window.partitionBy("walk").orderBy("page")), F.lit(False)).alias("repeated"))


@query("SELECT user_id, count(*) AS n_organic, count(*) FILTER (WHERE event_id % 9 = 0) AS n_undated, count(*) >= 3 AND count(*) FILTER (WHERE event_id % 9 = 0) = 0 AND bool_and(ts <= TIMESTAMP '2024-01-20') AS crossed FROM events WHERE event_type = 'signup' GROUP BY user_id")
def str14_organic_boundary(spark, sf):
    """All organic rows old, none undated, and at least three of them."""
    rows = table(spark, sf, "events").where("event_type = 'signup'").withColumn("at", F.when(F.expr("event_id % 9 <> 0"), F.col("ts")))
    found = rows.groupBy("user_id").agg(F.count("*").alias("n_organic"), n_if("at is null").alias("n_undated"), F.bool_and(F.coalesce(F.col("at") <= stamp("2024-01-20"), F.lit(True))).alias("old"))
    return found.select("user_id", "n_organic", "n_undated", F.expr("n_organic >= 3 and n_undated = 0 and old").alias("crossed"))


_EVID = "SELECT p_partkey AS id, greatest(p_size % 3 - 1, 0) AS n_listings, p_size % 2 AS n_raw, p_partkey % 5 AS n_rejected, p_size % 4 <> 0 AS has_state, p_size % 5 <> 0 AS has_path, p_partkey % 6 = 0 AS accessible FROM {part}"


@query(
    f"WITH e AS ({plain(_EVID)}) SELECT id, ['has_listings', 'confirmed_empty', 'parse_failed', 'unknown'][list_position([n_listings <> 0, has_state AND has_path AND n_raw = 0, NOT has_state OR accessible OR n_rejected <> 0, true], true)] AS evidence FROM e"
)
def str15_page_evidence(spark, sf):
    names = ("n_listings", "has_state", "has_path", "n_raw", "accessible", "n_rejected")
    return bound(spark, sf, _EVID).select("id", decisions.page_evidence(*map(F.col, names)).alias("evidence"))


_SCANS = "SELECT o_custkey AS cycle, o_orderstatus = 'F' AS complete, o_orderpriority <> '1-URGENT' AS healthy, o_orderkey % 4 AS scan, o_orderdate AS at FROM {orders}"


@query(f"WITH s AS ({plain(_SCANS)}) SELECT cycle, bool_and(complete AND healthy) AS commit_snapshot, NOT bool_and(complete) AS truncated, CASE WHEN bool_and(complete AND healthy) THEN max(s.at) END AS snapshot_at FROM s GROUP BY cycle".replace("o_orderdate AS at", "o_orderdate AS scanned").replace("max(s.at)", "max(scanned)"))
def str17_str28_snapshot_commit(spark, sf):
    """A full scan's time is kept only if every scan of the cycle was complete and its parser healthy."""
    both = F.bool_and(F.expr("complete and healthy"))
    return bound(spark, sf, _SCANS).groupBy("cycle").agg(both.alias("commit_snapshot"), (~F.bool_and("complete")).alias("truncated"), F.max("at").alias("last")).select("cycle", "commit_snapshot", "truncated", F.when(F.col("commit_snapshot"), F.col("last")).alias("snapshot_at"))


@query("WITH u AS (SELECT l_partkey AS id, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS prio, l_orderkey AS pos, l_linenumber AS n, l_suppkey AS s, l_extendedprice AS p FROM lineitem) SELECT id, prio, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, pos, n, s, p) AS k FROM u) WHERE k = 1")
def str29_prioritized_union(spark, sf):
    """Scans united by priority, the first row of each id kept."""
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey as id", "l_orderkey as pos", "l_linenumber as n", "l_suppkey as s", "l_extendedprice as p", "l_returnflag as f")
    scans = rows.where("f = 'N'").withColumn("prio", F.lit(0)).unionByName(rows.where("f <> 'N'").withColumn("prio", F.lit(1)))
    return ordered.keep_first(scans, ["id"], ["prio", "pos", "n", "s", "p"]).select("id", "prio", "pos")


@query("SELECT user_id % 5 AS source, CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events x WHERE x.user_id % 5 = events.user_id % 5) AS baseline, count(*) AS n FROM events GROUP BY ALL")
def str19_first_run_baseline(spark, sf):
    """What a source shows on its first day is the silent baseline; only later rows count as new."""
    rows = table(spark, sf, "events").select(F.expr("user_id % 5").alias("source"), F.to_date("ts").alias("day"))
    first = rows.groupBy("source").agg(F.min("day").alias("first"))
    return rows.join(first, "source").groupBy("source", (F.col("day") == F.col("first")).alias("baseline")).agg(F.count("*").alias("n"))


_CYCLES = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN CAST(-5 AS BIGINT) ELSE event_id * 997 % 900000 END AS elapsed_ms, event_id % 2 = 0 AS unbounded, event_id % 3 = 0 AS stopped, event_id % 5 = 0 AS failed FROM {events}"


@query(f"WITH c AS ({plain(_CYCLES)}) SELECT event_id, CAST(CASE WHEN elapsed_ms >= 600000 THEN 0 WHEN elapsed_ms >= 0 THEN 600000 - elapsed_ms ELSE 600000 END AS BIGINT) AS wait_ms, CASE WHEN event_id % 5 > 0 OR event_id % 6 = 0 THEN 0 ELSE 1 END AS exit_code FROM c")
def str21_str22_cadence_and_exit(spark, sf):
    rows = bound(spark, sf, _CYCLES)
    return rows.select("event_id", decisions.wait_ms(F.col("elapsed_ms"), 600_000).cast("bigint").alias("wait_ms"), decisions.exit_code(F.col("unbounded"), F.col("stopped"), F.col("failed")).alias("exit_code"))


_GATED = L + f", g AS (SELECT pos, published_at, pos % 5 AS prior, {NOW} AS now, CASE pos % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1000000 ELSE 2000000 END AS age_limit FROM l) "


@query(_GATED + "SELECT pos, CASE WHEN prior = 0 THEN TIMESTAMP '1998-01-01' ELSE now END AS first_seen, coalesce(age_limit, 10080) AS max_age_minutes, published_at IS NOT NULL AND date_diff('second', published_at, now) <= 60 * coalesce(nullif(age_limit, 0), 10080) OR prior IN (0, 1) AS approved, CASE WHEN prior IN (0, 1) THEN 3 WHEN published_at IS NOT NULL AND date_diff('second', published_at, now) <= 60 * coalesce(nullif(age_limit, 0), 10080) THEN 3 WHEN prior = 2 THEN 2 END AS gate_version FROM g".replace("coalesce(age_limit, 10080) AS", "coalesce(nullif(age_limit, 0), 10080) AS"))
def str2_str3_gate_marker(spark, sf):
    """First seen is stamped once; an approval carries the version of the gate that gave it, and one of an older gate is none."""
    prior = F.expr("pos % 5")
    rows = listings(spark, sf).withColumn("stamped", F.when(prior == 0, stamp("1998-01-01"))).withColumn("version", F.when(prior.isin(0, 1), decisions.GATE_VERSION).when(prior == 2, decisions.GATE_VERSION - 1))
    limit = F.coalesce(F.nullif(F.expr("case pos % 6 when 0 then null when 1 then 0 when 2 then 1000000 else 2000000 end"), F.lit(0)), F.lit(decisions.MAX_AGE_MINUTES))
    fresh = F.coalesce(F.timestamp_diff("SECOND", F.col("published_at"), F.expr(f"cast({NOW} as timestamp_ntz)")) <= limit * 60, F.lit(False))
    version = F.when(fresh | (F.col("version") == decisions.GATE_VERSION), decisions.GATE_VERSION).otherwise(F.col("version"))
    return rows.select("pos", F.coalesce("stamped", F.expr(f"cast({NOW} as timestamp_ntz)")).alias("first_seen"), limit.alias("max_age_minutes"), F.coalesce(version == decisions.GATE_VERSION, F.lit(False)).alias("approved"), version.alias("gate_version"))


# --- what is left of filters, functions and verification -------------------------------------------------------------


@query("SELECT page_id, page_id % 4 IN (0, 2) AND regexp_matches(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', ''), '\\d(\\.html)?$') AS trusted FROM pages")
def flt13_trusted_redirect(spark, sf):
    """Redirects of all pages: the host and the number in the path must be those asked for; www., query and fragment do not matter."""
    moved = "case page_id % 4 when 0 then concat(substring_index(url, '#', 1), '#top') when 1 then 'https://elsewhere.example.com/en/1' when 2 then replace(replace(url, '://www.', '://'), '://', '://www.') else concat(substring_index(url, '/', 3), '/x/999999999') end"
    return table(spark, sf, "pages").withColumn("final", F.expr(moved)).select("page_id", urls.same_target(F.col("url"), F.col("final")).alias("trusted"))


@query("SELECT event_type, 'n=' || CAST(count(*) AS STRING) || ' users=' || CAST(count(DISTINCT user_id) AS STRING) || ' last=' || strftime(max(ts), '%Y-%m-%d') AS note FROM events GROUP BY event_type")
def fn26_snk5_coverage_note(spark, sf):
    found = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"), F.max("ts").alias("at"))
    return found.select("event_type", F.concat(F.lit("n="), F.col("n"), F.lit(" users="), F.col("u"), F.lit(" last="), F.date_format("at", "yyyy-MM-dd")).alias("note"))


_CASES = """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS cycle, o_orderkey % 4 <> 0 AS target, CASE o_orderkey % 9 WHEN 0 THEN 'rejected' WHEN 1 THEN 'owner' END AS peer, CASE o_orderkey % 5 WHEN 0 THEN 'confirmed_owner' WHEN 1 THEN 'unknown' WHEN 2 THEN 'confirmed_intermediary' END AS cached, o_orderkey % 17 = 3 AS limited FROM {orders}"""


@query(
    f"WITH c AS ({plain(_CASES)}), n AS (SELECT *, target AND peer IS NULL AND cached IS NULL AS needs FROM c), r AS (SELECT *, count(*) FILTER (WHERE needs) OVER (PARTITION BY cycle ORDER BY id) AS rank, count(*) FILTER (WHERE needs AND limited) OVER (PARTITION BY cycle ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS halted FROM n) "
    "SELECT id, CASE WHEN NOT target THEN 'not_required' WHEN peer IS NOT NULL THEN CASE peer WHEN 'owner' THEN 'resolved' ELSE 'drop' END WHEN cached IS NOT NULL THEN 'cached_' || CASE cached WHEN 'confirmed_intermediary' THEN 'drop' ELSE cached END WHEN halted THEN 'skipped_rate_limited' WHEN rank <= 5 THEN 'fetch' ELSE 'deferred' END AS outcome FROM r"
)
def cls17_cls18_cls24_verification_order(spark, sf):
    """A cycle's linked listings in order: peer, cache, the halt after a 429, the cap on requests, a fetch."""
    needs = F.expr("target and peer is null and cached is null")
    upto = Window.partitionBy("cycle").orderBy("id")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = bound(spark, sf, _CASES).withColumn("rank", F.count_if(needs).over(upto)).withColumn("halted", F.coalesce(F.count_if(needs & F.col("limited")).over(before) > 0, F.lit(False)))
    return rows.select("id", decisions.linked_outcome(F.col("target"), F.col("peer"), F.col("cached"), F.col("halted"), F.col("rank"), 5).alias("outcome"))


_SENDS = L + ", d AS (SELECT pos, source, url, CASE pos % 6 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN NULL ELSE 200 END AS status, pos % 4 AS attempt FROM l) "


@query(
    _SENDS + "SELECT pos, CASE status WHEN 200 THEN 'sent' WHEN 404 THEN 'failed_permanent' WHEN 403 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN status = 200 THEN sha256(source || chr(10) || url) END AS text_sha256, CASE WHEN status IS NULL OR status = 429 THEN CAST(120000 * [1, 1, 2, 4][attempt + 1] AS BIGINT) END AS delay_ms, "
    "coalesce(status = 403, false) AS pauses FROM d"
)
def snk2_delivery(spark, sf):
    """Messages go to a sink once, as files of its own batch; what it answers moves the outbox row on: sent, failed for now, failed for good, or kept while the channel is paused."""
    rows = listings(spark, sf).select("pos", F.concat_ws("\n", "source", "url").alias("text"), F.expr("case pos % 6 when 0 then 429 when 1 then 403 when 2 then 404 when 3 then null else 200 end").alias("http"), F.expr("int(pos % 4)").alias("attempt"))
    path = scratch(spark, "sent")
    for _ in range(2):  # the same batch again replaces itself
        rows.where("http = 200").select("pos", "text").write.mode("overwrite").json(f"{path}/batch=1")
    sent = spark.read.schema("pos bigint, text string").json(f"{path}/batch=1").select("pos", F.sha2("text", 256).alias("text_sha256"))
    failure = decisions.delivery_failure(F.col("http"), F.lit(""))
    kind = F.when(F.col("http").isNull() | (F.col("http") != 200), failure["error_class"])
    status = F.when(kind.isNull(), "sent").when(kind == "permanent", "failed_permanent").when(kind == "operator_action", "pending").otherwise("failed")
    rows = rows.withColumn("kind", kind).select("pos", status.alias("status"), F.when(kind == "transient", state.backoff_ms(F.col("attempt"), F.lit(None))).alias("delay_ms"), F.coalesce(kind == "operator_action", F.lit(False)).alias("pauses"))
    return rows.join(sent, "pos", "left")


@query("SELECT 3 AS n_runs, 1 AS n_sent, 1 AS n_dry, 1 AS n_already")
def snk11_canary(spark, sf):
    """A message that is sent at most once: a dry run sends nothing and marks nothing, the next sends and marks, later ones see the mark."""
    path, told = scratch(spark, "canary"), []
    for dry in (True, False, False):
        told.append(stateful.canary(spark, path, dry))
    return spark.createDataFrame([(len(told), told.count("sent"), told.count("dry_run"), told.count("already_sent"))], "n_runs int, n_sent int, n_dry int, n_already int")


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark, sf, rows, by: str):
    """Rows with the events' `ts` as a stream of files in the order of their time; all rows of a key in a period are in one file.

    A micro-batch takes as many files as a period has on average, so there are as many batches as periods, however many files a large table makes. Where a batch ends inside a
    period a key's rows still come in their order, file by file.
    """
    path = scratch(spark, "events")
    days = ["2000-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "2100-01-01"]
    for start, end in zip(days, days[1:]):
        rows.where((F.col("ts") >= stamp(start)) & (F.col("ts") < stamp(end))).repartition(by).write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // (len(days) - 1)))).parquet(path)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    """Batch and stream agree: the keys that deduplication lets through once."""
    rows = _stream(spark, sf, table(spark, sf, "events").select("user_id", "event_type", "ts"), "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.run_to_end(stateful.first_seen(rows, ["user_id", "event_type"], "ts", "60 days"), scratch(spark, "stream")).select("user_id", "event_type")


@query("WITH e AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id) SELECT * FROM e")
def stream_state_table(spark, sf):
    """Micro-batches folded into a versioned state table by foreachBatch; each poll opens the table again, as after a restart."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    schema = "user_id bigint, value double, first_seen timestamp_ntz, last_seen timestamp_ntz"
    path, stream = scratch(spark, "state"), _stream(spark, sf, rows, "user_id").withColumn("first_seen", F.col("ts")).withColumn("last_seen", F.col("ts"))
    opened = lambda: stateful.StateTable(spark, path, schema, ["user_id"], ["value"], ["first_seen"], ["last_seen"], ["ts", "event_id"])
    checkpoint = scratch(spark, "checkpoint")
    opened().follow(stream, checkpoint)
    return opened().follow(stream, checkpoint)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    """Windowed counts of a stream; every batch gives the windows that changed."""
    rows = _stream(spark, sf, table(spark, sf, "events").select("event_type", "ts"), "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")
    return stateful.run_latest(counts, scratch(spark, "stream"), ["day", "event_type"]).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


_ATTEMPTED = "WITH e AS (SELECT user_id AS key, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "


@query(
    _ATTEMPTED + "l AS (SELECT key, coalesce(max(n) FILTER (WHERE ok), 0) AS last_ok, count(*) AS n_attempts FROM e GROUP BY key), i AS (SELECT key, n - row_number() OVER (PARTITION BY key ORDER BY n) AS island, n FROM e WHERE NOT ok), "
    "s AS (SELECT key, island, count(*) AS size, max(n) AS last FROM i GROUP BY ALL) "
    "SELECT l.key, n_attempts - last_ok AS consecutive_failures, n_attempts, count(*) FILTER (WHERE size >= 3) AS opened, count(*) FILTER (WHERE size >= 3 AND last < n_attempts) AS recovered FROM l LEFT JOIN s USING (key) GROUP BY ALL"
)
def stream_ups6_ups14_source_health(spark, sf):
    """Streaks and incidents as keyed state that outlives a run."""
    rows = table(spark, sf, "events").selectExpr("user_id as key", "unix_micros(cast(ts as timestamp)) as at", "event_id as tie", "event_type <> 'error' as ok", "ts")
    return stateful.run_latest(stateful.source_health(_stream(spark, sf, rows, "key").drop("ts")), scratch(spark, "stream"), ["key"])


@query(ORACLE_SQL["ups10_ups11_outbox_transitions"].replace("f.user_id, CASE", "f.user_id AS key, CASE"))
def stream_ups10_ups11_outbox(spark, sf):
    """The outbox' transitions as keyed state; what was being sent when the run ended is pending again."""
    event = "case event_type when 'click' then 'claim' when 'purchase' then 'done' when 'error' then 'fail' else event_type end as event"
    rows = table(spark, sf, "events").selectExpr("user_id as key", "unix_micros(cast(ts as timestamp)) as at", "event_id as tie", event, "ts")
    found = stateful.run_latest(stateful.outbox(_stream(spark, sf, rows, "key").drop("ts")), scratch(spark, "stream"), ["key"])
    return found.withColumn("status", F.expr("if(status = 'sending', 'pending', status)"))


_SPAN_MS, _DELAY_DAYS = 6 * 3_600_000, 9
_VERDICT = "CASE event_type WHEN 'purchase' THEN 'allow' WHEN 'error' THEN 'reject' ELSE 'defer' END"


@query(
    f"WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS at, {_VERDICT} AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events), "
    "f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS deadline, CAST(NULL AS BIGINT) AS expired, CAST(NULL AS BIGINT) AS told, CAST(NULL AS STRING) AS verdict FROM e UNION ALL "
    f"SELECT f.key, e.n, CASE WHEN e.verdict <> 'defer' THEN -1 WHEN f.deadline >= 0 AND f.deadline > e.at THEN f.deadline ELSE e.at + {_SPAN_MS} END, CASE WHEN f.deadline >= 0 AND f.deadline <= e.at THEN f.deadline END, CASE WHEN e.verdict <> 'defer' THEN e.at END, e.verdict "
    "FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1), m AS (SELECT key, max(n) AS n FROM f GROUP BY key) "
    "SELECT key, expired AS at, 'expired' AS outcome FROM f WHERE expired IS NOT NULL UNION ALL SELECT key, told, CASE verdict WHEN 'allow' THEN 'sent' ELSE 'dropped' END FROM f WHERE told IS NOT NULL "
    f"UNION ALL SELECT f.key, deadline, 'expired' FROM f JOIN m USING (key, n) WHERE deadline >= 0 AND deadline <= (SELECT max(epoch_us(ts) // 1000) - {_DELAY_DAYS} * 86400000 FROM events)"
)
def stream_ups8_ups9_holds(spark, sf):
    """Holds as keyed state with timers in event time: verdicts in time, and deadlines that passed."""
    rows = table(spark, sf, "events").selectExpr("user_id as key", "unix_millis(cast(ts as timestamp)) as at", "event_id as tie", f"{_VERDICT} as verdict", "ts")
    stream = _stream(spark, sf, rows, "key").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.run_to_end(stateful.holds(stream, _SPAN_MS, "ts", f"{_DELAY_DAYS} days"), scratch(spark, "stream"))
