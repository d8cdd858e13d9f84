"""Queries over relations: joins, aggregates, ordered operators, set operations."""

from __future__ import annotations


from pyspark.sql import functions as F

from brindle.functions import sellers, urls
from brindle.operators import decisions, graphs, matching, ordered
from brindle.plans.base import L, bound, listings, plain, query, scratch, table
from brindle.plans.records import BUCKET, C, KEYS, U, assessed, identity_keys

n_if = lambda e: F.count_if(F.expr(e))

# --- aggregates ------------------------------------------------------------------------------------------------------

_INVENTORY = "SELECT l_orderkey AS seller, CASE WHEN l_quantity > 25 THEN l_partkey END AS precise_key, CASE WHEN l_quantity <= 25 THEN l_suppkey END AS coarse_key FROM {lineitem}"
_AUDIT = f"""
WITH i AS ({plain(_INVENTORY)}), s AS (SELECT seller, count(DISTINCT precise_key) AS precise, count(DISTINCT coarse_key) AS coarse, count(*) AS ads FROM i GROUP BY seller),
v AS (SELECT *, CASE WHEN precise >= 5 THEN 'seller_inventory_limit' WHEN ads >= 10 AND coarse >= 5 THEN 'seller_mass_inventory' ELSE 'unknown' END AS verdict,
  CASE WHEN precise <= 1 THEN '0-1' WHEN precise <= 4 THEN CAST(precise AS STRING) WHEN precise <= 7 THEN '5-7' ELSE '8+' END AS bucket FROM s)
"""


def inventories(spark, sf):
    """Different keys of each kind a seller, and the verdict over them."""
    # each kind's different keys first, then counts of them: two counts of different values at once would copy every row three times
    keys = bound(spark, sf, _INVENTORY).select("seller", F.expr("stack(2, 'p', precise_key, 'c', coarse_key) as (kind, key)")).groupBy("seller", "kind", "key").agg(F.count("*").alias("n"))
    counts = keys.groupBy("seller").agg(n_if("kind = 'p' and key is not null").alias("precise"), n_if("kind = 'c' and key is not null").alias("coarse"), F.sum(F.expr("if(kind = 'p', n, 0)")).alias("ads"))
    verdict = sellers.inventory_verdict(F.lit(True), F.col("precise"), F.col("ads"), F.col("coarse"), F.lit(0))
    return counts.withColumn("verdict", verdict).withColumn("bucket", sellers.inventory_bucket(F.col("precise")))


@query(_AUDIT + "SELECT seller, precise, coarse, ads, verdict FROM v")
def agg5_cls14_inventory_verdict(spark, sf):
    return inventories(spark, sf).drop("bucket")


@query(_AUDIT + ", b AS (SELECT unnest(['0-1', '2', '3', '4', '5-7', '8+']) AS bucket) SELECT b.bucket, count(v.seller) AS n_sellers, count(*) FILTER (WHERE verdict <> 'unknown') AS n_rejected FROM b LEFT JOIN v USING (bucket) GROUP BY b.bucket")
def agg7_inventory_audit(spark, sf):
    """Histogram of sellers by the number of their precise keys, every bucket there."""
    buckets = F.broadcast(spark.createDataFrame([(b,) for b in sellers.BUCKETS], "bucket string"))  # six rows
    found = inventories(spark, sf).groupBy("bucket").agg(F.count("*").alias("n_sellers"), n_if("verdict <> 'unknown'").alias("n_rejected"))
    return buckets.join(found, "bucket", "left").na.fill(0)


_PAGES = "SELECT l_orderkey AS seller, l_linenumber AS page, l_partkey AS part, l_suppkey AS supp, l_quantity AS quantity FROM {lineitem}"


@query(f"WITH p AS ({plain(_PAGES)}) SELECT seller, count(DISTINCT part) AS n_keys, count(*) AS n_ads, count(DISTINCT page) AS n_pages, arg_min(supp, page * 1000000 + part * 100.0 + quantity / 100) AS first_total FROM p GROUP BY seller")
def agg6_merged_pages(spark, sf):
    """Page aggregates (key sets, counts) merged to sellers: sets united, counts summed, the total of the first page."""
    order = F.expr("page * 1000000 + part * 100.0D + quantity / 100")
    per_page = bound(spark, sf, _PAGES).groupBy("seller", "page").agg(F.collect_set("part").alias("keys"), F.count("*").alias("ads"), F.min_by("supp", order).alias("total"), F.min(order).alias("at"))
    merged = per_page.groupBy("seller").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.sum("ads").alias("n_ads"), F.count("*").alias("n_pages"), F.min_by("total", "at").alias("first_total"))
    return merged.select("seller", F.size("keys").cast("bigint").alias("n_keys"), "n_ads", "n_pages", "first_total")


_GATE = """
SELECT l_orderkey AS seller, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, l_returnflag = 'R' AS owner, l_linestatus = 'F' AS likely FROM {lineitem}
"""


@query(
    f"WITH g AS ({plain(_GATE)}), f AS (SELECT seller, part, min(n * 1000000000.0 + part * 100000.0 + supp) AS place FROM g GROUP BY seller, part), r AS (SELECT *, row_number() OVER (PARTITION BY seller ORDER BY place DESC) AS back FROM f), "
    "k AS (SELECT seller, string_agg(CAST(part AS STRING), ',' ORDER BY place) AS recent FROM r WHERE back <= 8 GROUP BY seller), s AS (SELECT seller, bool_and(owner) AS all_owner, bool_or(likely) AS any_likely, count(DISTINCT part) AS n_addresses FROM g GROUP BY seller) "
    "SELECT seller, recent, all_owner, any_likely, n_addresses, CASE WHEN all_owner THEN 'confirmed_owner' WHEN any_likely THEN 'profile_likely_intermediary' ELSE 'unknown' END AS verdict FROM s JOIN k USING (seller)"
)
def agg4_cls13_profile_gate(spark, sf):
    """Per seller: the last eight different addresses in order, whether all rows are owners' or any is likely none."""
    rows = bound(spark, sf, _GATE).withColumn("at", F.expr("n * 1000000000.0D + part * 100000.0D + supp"))
    first = rows.groupBy("seller", "part").agg(F.min("at").alias("at"), F.bool_and("owner").alias("owner"), F.bool_or("likely").alias("likely"))
    last = ordered.ranked(first, ["seller"], [F.desc("at")]).where("__rank <= 8").groupBy("seller").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"].cast("string")), ",").alias("recent"))
    flags = first.groupBy("seller").agg(F.bool_and("owner").alias("all_owner"), F.bool_or("likely").alias("any_likely"), F.count("*").alias("n_addresses"))
    verdict = F.when(F.col("all_owner"), "confirmed_owner").when(F.col("any_likely"), "profile_likely_intermediary").otherwise("unknown")
    return flags.join(last, "seller").withColumn("verdict", verdict)


@query(L + "SELECT source, min(published_at) AS oldest, max(published_at) AS newest, count(published_at) AS n_dated FROM l GROUP BY source")
def agg8_publication_range(spark, sf):
    return listings(spark, sf).groupBy("source").agg(F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"), F.count("published_at").alias("n_dated"))


@query("SELECT lang, source, count(*) AS n, count(*) - count(DISTINCT text) AS n_repeats, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source")
def agg9_agg16_frequencies(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("text")).alias("n_repeats"), F.sum("n_chars").alias("n_chars"))


_TRIES = "SELECT event_id, ts, user_id % 5 AS source, CAST(CAST(ts AS DATE) AS STRING) AS cycle, event_type <> 'error' AS success, value FROM {events}"
T = f"WITH t AS ({plain(_TRIES)}) "


@query(T + "SELECT source, avg(CAST(success AS INT)) AS success_rate FROM t GROUP BY source")
def agg10_success_rate(spark, sf):
    return bound(spark, sf, _TRIES).groupBy("source").agg(F.avg(F.col("success").cast("int")).alias("success_rate"))


@query(
    T + ", r AS (SELECT source, success, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY source, success ORDER BY ts, event_id) AS b FROM t), i AS (SELECT source, a - b AS g, count(*) AS n FROM r WHERE NOT success GROUP BY ALL) SELECT source, max(n) AS longest_streak FROM i GROUP BY source"
)
def agg11_failure_streaks(spark, sf):
    return ordered.longest_streaks(bound(spark, sf, _TRIES), "source", "cycle", ["ts", "event_id"], F.expr("not success"))


_CYCLES = T + ", c AS (SELECT cycle, count(*) AS n, count(*) FILTER (WHERE success) AS ok, max(value) AS most FROM t GROUP BY cycle), s AS (SELECT *, CASE WHEN ok = n THEN 'complete' WHEN ok = 0 THEN 'failed' ELSE 'degraded' END AS status FROM c) "


def cycles(spark, sf):
    c = bound(spark, sf, _TRIES).groupBy("cycle").agg(F.count("*").alias("n"), n_if("success").alias("ok"), F.max("value").alias("most"))
    return c.withColumn("status", F.when(F.expr("ok = n"), "complete").when(F.expr("ok = 0"), "failed").otherwise("degraded"))


@query(_CYCLES + "SELECT cycle, n, ok, status FROM s")
def agg13_cycle_status(spark, sf):
    return cycles(spark, sf).drop("most")


@query(
    _CYCLES + "SELECT count(*) AS cycles, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, max(most) AS most, CASE WHEN count(*) = 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'complete') = 30 THEN 'PASS' WHEN count(*) FILTER (WHERE status = 'failed') = count(*) THEN 'FAIL' ELSE 'DEGRADED' END AS verdict FROM s"
)
def agg12_agg14_agg18_soak_summary(spark, sf):
    s = cycles(spark, sf).agg(F.count("*").alias("cycles"), n_if("status = 'complete'").alias("complete"), n_if("status = 'failed'").alias("failed"), F.max("most").alias("most"))
    return s.withColumn("verdict", F.expr("case when cycles = 0 then 'FAIL' when complete = 30 then 'PASS' when failed = cycles then 'FAIL' else 'DEGRADED' end"))


@query(C + "SELECT source, count(*) FILTER (WHERE why_not IN ('conflict', 'business_ambiguous')) AS n_lost, count(*) FILTER (WHERE why_not IN ('conflict', 'business_ambiguous')) = 0 AS healthy, count(why_not) AS n_rejected FROM rj GROUP BY source")
def agg17_agg23_parser_loss(spark, sf):
    rows = assessed(listings(spark, sf)).withColumn("why", sellers.rejection_reason(F.col("seller_type"), F.col("level")))
    return rows.groupBy("source").agg(n_if("why in ('conflict', 'business_ambiguous')").alias("n_lost"), n_if("why is not null").alias("n_rejected")).withColumn("healthy", F.expr("n_lost = 0"))


@query(C + f"SELECT {BUCKET} AS bucket, count(*) FILTER (WHERE source = 'domria') AS domria, count(*) FILTER (WHERE source = 'lun') AS lun, count(*) FILTER (WHERE source = 'olx') AS olx, count(*) FILTER (WHERE source = 'rieltor') AS rieltor FROM rj GROUP BY 1")
def agg24_outcomes_pivoted(spark, sf):
    rows = assessed(listings(spark, sf)).withColumn("bucket", sellers.decision_bucket(F.col("seller_type"), F.col("level")))
    return rows.groupBy("bucket").pivot("source", ["domria", "lun", "olx", "rieltor"]).count().na.fill(0)


@query("SELECT count(*) AS n, count(*) > 0 AS any_row, count(DISTINCT user_id) AS n_users FROM events WHERE event_type = 'error'")
def agg19_count_and_existence(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users")).withColumn("any_row", F.expr("n > 0"))


@query("WITH f AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM f) SELECT event_type, user_id, total <= 120 AS complete FROM r WHERE n <= 120")
def agg20_unique_sample(spark, sf):
    first = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    return ordered.cap_per_group(first, "event_type", ["first"], 120).select("event_type", "user_id", F.expr("not truncated").alias("complete"))


@query("WITH s AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS page FROM lineitem), f AS (SELECT *, min(page) OVER (PARTITION BY k) = page AS fresh FROM s) SELECT page, count(*) AS n_keys, count(*) FILTER (WHERE fresh) AS n_new FROM f GROUP BY page")
def agg21_page_novelty(spark, sf):
    return ordered.novelty(table(spark, sf, "lineitem").selectExpr("l_partkey as k", "l_linenumber as page"), "k", "page")


@query(L + ", r AS (SELECT source, amount, currency, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM l) SELECT source, count(*) AS n, bool_and(amount IS NULL) AS no_amount, bool_and(currency IS NULL) AS no_currency, count(currency) / count(*) AS filled FROM r WHERE n <= 5 GROUP BY source")
def agg22_sample_verdict(spark, sf):
    first = ordered.ranked(listings(spark, sf), ["source"], ["pos"]).where("__rank <= 5")
    return first.groupBy("source").agg(F.count("*").alias("n"), F.bool_and(F.col("amount").isNull()).alias("no_amount"), F.bool_and(F.col("currency").isNull()).alias("no_currency"), (F.count("currency") / F.count("*")).alias("filled"))


@query("SELECT p_size AS pages, p_size * 2 * 30 * CAST(24 * 60 / 10 AS BIGINT) AS monthly, CAST(p_size AS BIGINT) * 2 * 30 * 144 > 100000 AS over_budget, greatest(600, ceil(p_size * 2 * 30 * 86400.0 / 100000)) AS least_interval_s FROM (SELECT DISTINCT p_size FROM part)")
def agg25_cls23_request_volume(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("pages")).distinct().withColumn("monthly", F.expr("cast(pages * 2 * 30 * 144 as bigint)"))
    return sizes.select("pages", "monthly", F.expr("monthly > 100000").alias("over_budget"), F.greatest(F.lit(600.0), F.ceil(F.expr("pages * 2 * 30 * 86400.0D / 100000")).cast("double")).alias("least_interval_s"))


# --- ordered operators -----------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def win1_keep_first(spark, sf):
    return ordered.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events) SELECT event_type, event_id, total > 120 AS truncated FROM r WHERE n <= 120")
def win2_win3_cap_per_category(spark, sf):
    return ordered.cap_per_group(table(spark, sf, "events").select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"], 120).drop("ts")


@query("WITH r AS (SELECT *, event_type IN ('error', 'purchase') AS prio FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY prio, event_type ORDER BY ts, event_id) AS turn FROM r) SELECT event_id, event_type, prio, turn FROM t ORDER BY prio DESC, turn, event_type LIMIT 400")
def win4_round_robin(spark, sf):
    rows = table(spark, sf, "events").withColumn("prio", F.col("event_type").isin("error", "purchase"))
    return ordered.round_robin(rows, "prio", "event_type", ["ts", "event_id"], 400).select("event_id", "event_type", "prio", "turn")


@query("WITH f AS (SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM f) SELECT event_type, user_id, event_id FROM r WHERE n <= 160")
def win5_last_distinct(spark, sf):
    return ordered.last_distinct(table(spark, sf, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", ["event_id"], 160)


@query("WITH s AS (SELECT user_id, coalesce(value <= lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS falls FROM events WHERE event_type = 'purchase') SELECT user_id, count(*) AS n_rows, bool_and(falls) AND count(*) >= 3 AS non_increasing FROM s GROUP BY user_id")
def win6_non_increasing(spark, sf):
    return ordered.non_increasing(table(spark, sf, "events").where("event_type = 'purchase'"), "user_id", "value", ["ts", "event_id"])


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 30")
def win7_preview(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(30)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderkey LIMIT 20")
def win8_retry_queue(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus in ('O', 'P')").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def win9_recent(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderkey")).limit(50)


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate + INTERVAL 20 DAYS <= TIMESTAMP '1995-03-01' ORDER BY o_orderdate, o_custkey, o_orderkey")
def win10_due_holds(spark, sf):
    due = F.expr("o_orderdate + interval 20 days <= cast('1995-03-01' as timestamp_ntz)")
    return table(spark, sf, "orders").where(due).select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderdate", "o_custkey", "o_orderkey")


@query("SELECT regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1")
def win13_host_tally(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host")


@query("SELECT o_orderkey, greatest(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 30 DAYS), TIMESTAMP '1997-01-01') AS boundary FROM orders")
def win14_later_date(spark, sf):
    from brindle.operators.freshness import monitoring_boundary

    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", monitoring_boundary(F.when(F.expr("o_orderkey % 2 = 0"), F.col("o_orderdate")), F.expr("o_orderdate - interval 30 days"), F.expr("cast('1997-01-01' as timestamp_ntz)")).alias("boundary"))


# --- joins -----------------------------------------------------------------------------------------------------------

_SEEN = L + ", s AS (SELECT source, source_id, url FROM l WHERE pos % 7 = 3), o AS (SELECT url FROM l WHERE pos % 11 = 5) "


@query(_SEEN + "SELECT pos FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = l.source AND s.source_id = l.source_id) AND NOT EXISTS (SELECT 1 FROM o WHERE o.url = l.url)")
def jn1_flt7_set3_unseen(spark, sf):
    rows = listings(spark, sf)
    by_id = matching.unseen(rows, rows.where("pos % 7 = 3"), [["source", "source_id"]])
    return matching.unseen(by_id, rows.where("pos % 11 = 5"), [["url"]]).select("pos")


_KEYS = KEYS.replace("GROUP BY ALL", "GROUP BY pos, source, source_id, key")
_REASON = """CASE WHEN key LIKE 'lun:group:%' AND a = 'lun_cluster' AND b = 'lun_cluster' THEN 'lun_group_id' WHEN key LIKE 'lun:%' THEN NULL WHEN (a = 'explicit_external' OR b = 'explicit_external') AND (key LIKE 'olx:token:%' OR key LIKE 'rieltor:id:%' OR key LIKE 'domria:id:%') THEN 'explicit_external_listing_id'
 WHEN (a = 'explicit_external' OR b = 'explicit_external') AND key LIKE 'url:%' THEN 'explicit_external_url' WHEN a = 'own' AND b = 'own' AND key LIKE '%:id:%' OR a = 'own' AND b = 'own' AND key LIKE 'olx:token:%' THEN 'same_platform_listing_id' WHEN a = 'own' AND b = 'own' AND key LIKE 'url:%' THEN 'same_canonical_url' END"""
_MATCHES = _KEYS + f", j AS (SELECT x.source, x.source_id, y.source AS peer_source, y.source_id AS peer_id, x.key, x.key_class AS a, y.key_class AS b FROM k x JOIN k y ON x.key = y.key AND NOT (x.source = y.source AND x.source_id = y.source_id)), mt AS (SELECT source, source_id, peer_source, peer_id, key, {_REASON} AS reason FROM j) "


@query(_MATCHES + "SELECT * FROM mt WHERE reason IS NOT NULL")
def jn2_jn3_cls11_key_matches(spark, sf):
    keys = identity_keys(listings(spark, sf))
    return matching.key_matches(keys.drop("pos"), keys)


_OVERLAP = "ov AS (SELECT rooms, area, amount, lower(trim(currency)) AS cur, count(DISTINCT source_id) AS n FROM l WHERE rooms > 0 AND area > 0 AND amount IS NOT NULL AND currency IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_id) > 1)"


def _rounded(df):
    """Prices in coarse steps, so that some listings overlap."""
    return df.withColumn("amount", F.floor(F.col("amount") / 20000)).withColumn("cur", F.lower(F.trim("currency")))


@query(L.replace("THEN o_totalprice END AS amount", "THEN floor(o_totalprice / 20000) END AS amount") + "," + _OVERLAP + " SELECT pos FROM l JOIN ov ON l.rooms = ov.rooms AND l.area = ov.area AND l.amount = ov.amount AND lower(trim(l.currency)) = ov.cur")
def jn4_attribute_overlap(spark, sf):
    valid = F.expr("rooms > 0 and area > 0 and amount is not null and cur is not null")
    return matching.attribute_overlap(_rounded(listings(spark, sf)), ["rooms", "area", "amount", "cur"], ["source_id"], valid).select("pos")


_RANK = "list_position(['explicit_external_listing_id', 'explicit_external_url', 'same_platform_listing_id', 'same_canonical_url', 'lun_group_id'], reason)"


@query(
    _MATCHES.replace("THEN o_totalprice END AS amount", "THEN floor(o_totalprice / 20000) END AS amount") + ", " + _OVERLAP
    + f", hit AS (SELECT source, source_id, arg_min(peer_source || '/' || peer_id, printf('%d', {_RANK}) || peer_source || '/' || peer_id) AS duplicate_of, list_reduce(list_transform(list_sort(list_distinct(list(printf('%d', {_RANK}) || reason))), lambda x: x[2:]), lambda a, b: a || ',' || b) AS reasons FROM mt WHERE reason IS NOT NULL GROUP BY source, source_id), "
    "ps AS (SELECT l.pos FROM l JOIN ov ON l.rooms = ov.rooms AND l.area = ov.area AND l.amount = ov.amount AND lower(trim(l.currency)) = ov.cur) "
    "SELECT l.pos, h.duplicate_of, h.reasons, CASE WHEN h.duplicate_of IS NOT NULL THEN 'confirmed_duplicate' WHEN l.pos IN (SELECT pos FROM ps) THEN 'possible_duplicate' ELSE 'unique' END AS verdict FROM l LEFT JOIN hit h ON l.source = h.source AND l.source_id = h.source_id"
)
def win11_cls12_duplicate_verdict(spark, sf):
    rows = _rounded(listings(spark, sf)).select("pos", "source", "source_id", "rooms", "area", "amount", "cur")
    keys = identity_keys(listings(spark, sf)).drop("pos")
    overlaps = matching.attribute_overlap(rows, ["rooms", "area", "amount", "cur"], ["source_id"], F.expr("rooms > 0 and area > 0 and amount is not null and cur is not null"))
    return matching.verdicts(rows, matching.best_matches(keys), overlaps).select("pos", "duplicate_of", "reasons", "verdict")


@query(_MATCHES + ", bad AS (SELECT source, source_id FROM l WHERE platform_agent), p AS (SELECT mt.source, mt.source_id, min(peer_source || '/' || peer_id) AS peer FROM mt JOIN bad ON bad.source = peer_source AND bad.source_id = peer_id WHERE reason LIKE 'explicit%' GROUP BY 1, 2) SELECT l.pos, p.peer, p.peer IS NOT NULL AS dropped FROM l LEFT JOIN p ON p.source = l.source AND p.source_id = l.source_id")
def jn5_cls20_rejected_peer(spark, sf):
    """Listings that an explicit key ties to a rejected one fall with it."""
    rows = listings(spark, sf)
    keys = identity_keys(rows)
    bad = rows.where("platform_agent").select(F.col("source").alias("peer_source"), F.col("source_id").alias("peer_id"))
    hits = matching.key_matches(keys.drop("pos"), keys).where("reason like 'explicit%'").join(bad, ["peer_source", "peer_id"])
    peer = hits.groupBy("source", "source_id").agg(F.min(F.concat_ws("/", "peer_source", "peer_id")).alias("peer"))
    return rows.join(peer, ["source", "source_id"], "left").select("pos", "peer", F.col("peer").isNotNull().alias("dropped"))


@query(U + ", p AS (SELECT pos, source, source_id FROM c WHERE source = 'olx'), t AS (SELECT pos, external FROM e WHERE source = 'lun') SELECT t.pos, p.pos AS peer FROM t LEFT JOIN p ON p.source_id = t.external")
def jn6_peer_by_token(spark, sf):
    rows = listings(spark, sf)
    token = urls.external_id(urls.platform(urls.host(F.col("url"))), F.col("url"))
    peers = ordered.keep_first(rows.where("source = 'olx'"), ["source_id"], ["pos"]).select(F.col("source_id").alias("external"), F.col("pos").alias("peer"))
    return rows.where("source = 'lun'").withColumn("external", token).join(peers, "external", "left").select("pos", "peer")


_CHECKS = "SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'confirmed_owner' WHEN 'view' THEN 'confirmed_intermediary' WHEN 'click' THEN 'unknown' WHEN 'error' THEN 'temporary_failure' ELSE 'unknown' END AS verdict FROM {events}"


@query(
    f"WITH c AS (SELECT user_id, arg_max(verdict, row(ts, event_id)) AS verdict, max(ts) AS checked FROM ({plain(_CHECKS)}) GROUP BY user_id), t AS (SELECT * FROM (VALUES ('confirmed_owner', INTERVAL 30 DAYS), ('confirmed_intermediary', INTERVAL 30 DAYS), ('unknown', INTERVAL 1 DAY), ('temporary_failure', INTERVAL 1 MINUTE)) v(verdict, life)), "
    "x AS (SELECT user_id, verdict FROM c JOIN t USING (verdict) WHERE checked + life > TIMESTAMP '2024-01-30 12:00:00') SELECT c_custkey, verdict, verdict IS NOT NULL AS cached FROM customer LEFT JOIN x ON user_id = c_custkey"
)
def jn7_ups7_verdict_cache(spark, sf):
    """The last verdict of each key, if its time to live has not run out."""
    cache = bound(spark, sf, _CHECKS).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("verdict", F.struct("ts", "event_id")).alias("verdict"), F.max("ts").alias("at"))
    cache = cache.withColumn("expires_at", decisions.expires_at(F.col("verdict"), F.col("at")))
    live = matching.live_cache(table(spark, sf, "customer").select("c_custkey"), cache, ["c_custkey"], F.expr("cast('2024-01-30 12:00:00' as timestamp_ntz)"))
    return live.select("c_custkey", "verdict", F.col("verdict").isNotNull().alias("cached"))


@query("WITH prior AS (SELECT l_suppkey AS s, l_partkey AS a FROM lineitem WHERE l_linenumber <= 2), now AS (SELECT l_suppkey AS s, l_partkey AS a FROM lineitem WHERE l_linenumber = 3), u AS (SELECT s, a FROM now UNION SELECT prior.s, prior.a FROM prior WHERE s IN (SELECT s FROM now)) SELECT s, count(*) AS n_addresses FROM u GROUP BY s")
def jn8_set2_prior_addresses(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_suppkey as s", "l_partkey as a", "l_linenumber as n")
    now = rows.where("n = 3").select("s").distinct()
    return rows.where("n <= 3").select("s", "a").distinct().join(now, "s", "left_semi").groupBy("s").agg(F.count("*").alias("n_addresses"))


@query("WITH i AS (SELECT l_linenumber AS category, l_orderkey AS id, min(l_partkey) AS p FROM lineitem GROUP BY ALL), k AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT i.*, k.id IS NOT NULL AS known FROM i LEFT JOIN k USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY category, known ORDER BY id) AS n FROM m) SELECT category, id, CASE WHEN known THEN 'known' WHEN n <= 8 THEN 'fetch' ELSE 'deferred' END AS plan FROM r")
def jn9_str20_planned_fetches(spark, sf):
    ids = table(spark, sf, "lineitem").selectExpr("l_linenumber as category", "l_orderkey as id").distinct()
    return matching.planned_fetches(ids, table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as id"), "category", ["id"], 8)


@query("WITH h AS (SELECT s_suppkey % 5 AS source, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1), a AS (SELECT DISTINCT user_id % 4 AS source FROM events WHERE event_type = 'error'), e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS source) SELECT e.source, coalesce(h.n, 0) AS n_failures, a.source IS NOT NULL AS alerted, CASE WHEN h.source IS NULL THEN 'disabled' ELSE 'seen' END AS state FROM e LEFT JOIN h USING (source) LEFT JOIN a USING (source)")
def jn12_jn13_health_and_alerts(spark, sf):
    """Enabled sources against their health and alert rows; those without any are disabled."""
    enabled = spark.range(7).selectExpr("id as source")
    health = table(spark, sf, "supplier").where("s_acctbal < 0").groupBy(F.expr("s_suppkey % 5").alias("source")).agg(F.count("*").alias("n_failures"))
    alerts = table(spark, sf, "events").where("event_type = 'error'").selectExpr("user_id % 4 as source", "true as alerted").distinct()
    joined = enabled.join(health, "source", "left").join(alerts, "source", "left").withColumn("state", F.when(F.col("n_failures").isNull(), "disabled").otherwise("seen"))
    return joined.na.fill(0, ["n_failures"]).na.fill(False, ["alerted"])


@query("SELECT o_orderkey, o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS open FROM orders")
def jn14_flt9_membership(spark, sf):
    held = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("open", F.lit(True))
    return table(spark, sf, "orders").join(held, "o_custkey", "left").select("o_orderkey", F.coalesce("open", F.lit(False)).alias("open"))


_WALKED = "SELECT l_orderkey AS walk, l_linenumber AS page, l_suppkey AS id, l_returnflag = 'N' AND l_linenumber = 1 AS late, l_orderkey % 4 + 1 AS resume FROM {lineitem}"


@query(
    f"WITH w AS ({plain(_WALKED)}), s AS (SELECT DISTINCT walk, id FROM w WHERE NOT late), m AS (SELECT DISTINCT walk, id, 'inserted' AS why FROM w WHERE late AND NOT EXISTS (SELECT 1 FROM s WHERE s.walk = w.walk AND s.id = w.id) "
    "UNION ALL SELECT DISTINCT walk, id, 'skipped' FROM w WHERE NOT late AND page < resume AND id NOT IN (SELECT x.id FROM w x WHERE x.walk = w.walk AND NOT x.late AND x.page >= x.resume)) SELECT walk, id, why FROM m"
)
def jn15_late_inserts(spark, sf):
    """What a walk over pages misses: ids that came to its first page after that was read, and ids on the pages before the one where it went on."""
    rows = bound(spark, sf, _WALKED)
    seen = rows.where("not late").select("walk", "id").distinct()
    inserted = rows.where("late").select("walk", "id").distinct().join(seen, ["walk", "id"], "left_anti").withColumn("why", F.lit("inserted"))
    after = rows.where("not late and page >= resume").select("walk", "id").distinct()
    skipped = rows.where("not late and page < resume").select("walk", "id").distinct().join(after, ["walk", "id"], "left_anti").withColumn("why", F.lit("skipped"))
    return inserted.unionByName(skipped)


@query(_KEYS + "SELECT x.pos, y.pos AS peer, bool_or(x.source = y.source AND x.source_id = y.source_id) AS same FROM k x JOIN k y USING (key) GROUP BY x.pos, y.pos")
def flt12_same_listing(spark, sf):
    """Which of the listings that share a key are the listing itself."""
    keys = identity_keys(listings(spark, sf))
    peers = keys.select("key", F.col("pos").alias("peer"), F.col("source").alias("peer_source"), F.col("source_id").alias("peer_id"))
    return keys.join(peers, "key").groupBy("pos", "peer").agg(F.bool_or(F.expr("source = peer_source and source_id = peer_id")).alias("same"))


@query(_KEYS + "SELECT pos, key, key_class FROM k")
def win12_best_key_class(spark, sf):
    return matching.best_class(identity_keys(listings(spark, sf))).withColumn("pos", F.col("source_id").cast("bigint")).select("pos", "key", "key_class")


_KEEP = _KEYS.replace("WITH ", "WITH RECURSIVE ", 1) + """, adj AS (SELECT DISTINCT a.pos AS p, b.pos AS q FROM k a JOIN k b ON a.key = b.key AND b.pos < a.pos),
r AS (SELECT 0 AS i, pos, CASE WHEN pos NOT IN (SELECT p FROM adj) THEN true END AS kept FROM (SELECT DISTINCT pos FROM k)
  UNION ALL SELECT i + 1, pos, coalesce(kept, d) FROM (SELECT r.i, r.pos, any_value(r.kept) AS kept, CASE WHEN coalesce(bool_or(x.kept), false) THEN false WHEN count(adj.q) = count(x.kept) THEN true END AS d
    FROM r LEFT JOIN adj ON adj.p = r.pos LEFT JOIN r x ON x.pos = adj.q GROUP BY r.i, r.pos) WHERE EXISTS (SELECT 1 FROM r WHERE kept IS NULL))
SELECT pos, kept FROM r WHERE i = (SELECT max(i) FROM r)"""


@query(_KEEP)
def h1_sequential_keepers(spark, sf):
    """Greedy keepers in the order of rows: a listing is kept if no listing kept before it has one of its keys."""
    spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    keys = identity_keys(listings(spark, sf)).select("pos", "key")
    return matching.keepers(keys, graphs.key_components(keys))


# --- set operations --------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, 'customer' AS bucket, c_mktsegment AS label, NULL AS size FROM customer UNION ALL SELECT p_partkey, 'part', NULL, p_size FROM part UNION ALL SELECT s_suppkey, 'supplier', s_name, NULL FROM supplier")
def set1_union_of_buckets(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey as id", "'customer' as bucket", "c_mktsegment as label")
    b = table(spark, sf, "part").selectExpr("p_partkey as id", "'part' as bucket", "p_size as size")
    c = table(spark, sf, "supplier").selectExpr("s_suppkey as id", "'supplier' as bucket", "s_name as label")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("WITH a AS (SELECT o_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT k, len(list_intersect(x, y)) AS n_shared, list_has_any(x, y) AS overlaps FROM a JOIN b USING (k)")
def set4_key_intersection(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    sets = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(F.expr("l_returnflag = 'R'"), F.col("l_partkey"))).alias("x"), F.collect_set(F.when(F.expr("l_returnflag <> 'R'"), F.col("l_partkey"))).alias("y"))
    return sets.where("size(x) > 0 and size(y) > 0").select("k", F.size(F.array_intersect("x", "y")).cast("bigint").alias("n_shared"), F.arrays_overlap("x", "y").alias("overlaps"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def set5_distinct_lists(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n"))


