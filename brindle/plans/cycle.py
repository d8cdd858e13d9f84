"""The poll cycle as one query: retries, holds, filters, peers, baselines, duplicates in the order of sources, freshness, the seller check, deliveries, over state tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import sellers
from brindle.operators import freshness as fresh
from brindle.operators import matching
from brindle.operators.stored import stored
from brindle.plans.base import bound, listings, plain, query, scratch
from brindle.plans.records import _CLS, _GEO, KEYS, flagged, identity_keys, provenance

#: Sources are visited in this order; an earlier one's listing is kept where two are the same. Holds come before all of them.
ORDER = ["domria", "lun", "rieltor", "olx"]
_STEP = 10**12
#: Tables of rows that are only ever added, and tables of which the last row of a key counts.
ADDED = {
    "seen": "pos bigint, source string, source_id string, poll int",
    "identities": "key string, source string, source_id string, poll int",
    "decisions": "pos bigint, outcome string, poll int",
}
LATEST = {
    "outbox": ("pos", "pos bigint, ord bigint, source string, source_id string, status string, attempts int, assessment string, origin string, origin_id string, poll int"),
    "holds": ("pos", "pos bigint, source string, source_id string, state string, release_at timestamp_ntz, published_at timestamp_ntz, refreshed_at timestamp_ntz, keys array<string>, assessment string, origin string, origin_id string, poll int"),
    "sources": ("source", "source string, established_at timestamp_ntz, complete_at timestamp_ntz, poll int"),
    "settings": ("name", "name string, value timestamp_ntz, poll int"),
}
SCHEMAS = ADDED | {name: schema for name, (_, schema) in LATEST.items()}


class CycleState:
    """The tables that outlive a poll. A poll adds its own part to each, `path`/<table>/p<n>, and counts once `path`/commits/<n> is there.

    A poll that broke off leaves parts that nobody reads and the next attempt overwrites; numbers may have gaps. Every `every` polls the parts are
    folded into a snapshot, tables of last rows to one row a key, so that a reader never has more than that many parts.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 50):
        self.spark, self.path, self.every = spark, path, every
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(conf)

    def _numbers(self, folder: str) -> list[int]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    @property
    def version(self) -> int:
        """The highest poll that is whole."""
        return max([*self._numbers("commits"), *self._numbers("snapshots")], default=0)

    def _mark(self, folder: str, number: int) -> None:
        self._fs.create(self._at(f"{self.path}/{folder}/{number}"), True).close()

    def read(self, name: str) -> DataFrame:
        base = max(self._numbers("snapshots"), default=0)
        paths = [f"{self.path}/{name}/s{base}"] * bool(base) + [f"{self.path}/{name}/p{n}" for n in self._numbers("commits") if n > base]
        reader = self.spark.read.schema(SCHEMAS[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def current(self, name: str) -> DataFrame:
        """The last row of each key."""
        key, rows = LATEST[name][0], self.read(name)
        rest = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "poll").alias("last")).select(key, "last.*")

    def commit(self, number: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
            df = df.withColumn("poll", F.lit(number))
            df.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.mode("overwrite").parquet(f"{self.path}/{name}/p{number}")
        self._mark("commits", number)
        base = max(self._numbers("snapshots"), default=0)
        if sum(n > base for n in self._numbers("commits")) >= self.every:
            self.compact()

    def compact(self) -> None:
        """A snapshot of all whole polls; the parts in it go once it is whole."""
        n, old = self.version, max(self._numbers("snapshots"), default=0)
        for name in SCHEMAS:
            (self.current(name) if name in LATEST else self.read(name)).write.mode("overwrite").parquet(f"{self.path}/{name}/s{n}")
        parts = [x for x in self._numbers("commits") if x <= n]
        self._mark("snapshots", n)
        for name in SCHEMAS:
            for gone in [f"s{old}"] * (0 < old < n) + [f"p{x}" for x in parts]:
                self._fs.delete(self._at(f"{self.path}/{name}/{gone}"), True)
        for x in parts:
            self._fs.delete(self._at(f"{self.path}/commits/{x}"), False)


@dataclass
class Poll:
    """One poll: its clock, the sources that failed (what they show is not looked at) and those that were read only in part."""

    number: int
    now: str
    failed: list[str] = field(default_factory=list)
    degraded: list[str] = field(default_factory=list)


@dataclass
class Rules:
    """Limits of the cycle. At most `checks` sellers are looked up and `retries` messages repeated a poll; a deferred row waits for `hold`."""

    max_age: str = "interval 1000 days"
    grace: str = "interval 60 minutes"
    hold: str = "interval 30 minutes"
    checks: int = 8
    retries: int = 20


def _threshold(rows: DataFrame, most: int | None, stop: Column) -> int | None:
    """The place after which nothing more is done: that of the `most`-th row, or of the first that asks to stop."""
    ends = [rows.where(stop).agg(F.min("ord")).first()[0]]
    if most is not None:
        n, last = rows.select("ord").orderBy("ord").limit(most).agg(F.count("*"), F.max("ord")).first()
        ends.append(last if n == most else None)
    return min((e for e in ends if e is not None), default=None)


def _sent(rows: DataFrame) -> DataFrame:
    """`rows` (ord, send) with status: after the first one that the channel asks to wait for, nothing more is sent."""
    end = _threshold(rows, None, F.col("send") == "rate_limited")
    late = F.lit(False) if end is None else F.col("ord") > end
    return rows.withColumn("status", F.when(late, "pending").when(F.col("send") == "ok", "sent").otherwise("failed"))


def poll(state: CycleState, p: Poll, batch: DataFrame, replies: DataFrame, rules: Rules) -> None:
    """One poll over `batch` (listings with accepted, seller_type, level, needs_check) and `replies`: pos, cached, check (allow, reject, unresolved,
    rate_limited: what looking up the seller gives; no reply counts as unresolved) and send (ok, error, rate_limited; none counts as an error).

    In this order: messages that are owed, held rows, then the sources' rows. A row that shares an identity key with one enqueued before it is a duplicate;
    one that is not new leaves with its kind of freshness, judged by its source's last complete poll; one whose seller has to be looked up is enqueued, rejected or
    held. Rejected and held rows publish no keys. The number of lookups is bounded, and the first reply that asks to wait ends them: until then all goes as if there
    were no bound, so the place where lookups end follows from a first fold, and a second one takes what comes after it as unresolved.
    A row with a live hold is left to it. Held rows were new when they came, so a later poll of their source does not make them late.
    """
    if state.version >= p.number:
        return
    spark = state.spark
    now = F.lit(p.now).cast("timestamp_ntz")
    interval = lambda text: F.expr(text)
    cutover = state.current("settings").where("name = 'policy_cutover'").first()
    cutover_at = F.lit(str(cutover["value"])).cast("timestamp_ntz") if cutover else now
    sources = state.current("sources")
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("source"))
    place = lambda r: p.number * F.lit(_STEP * 10) + r * F.lit(_STEP) + F.col("pos")
    batch = batch.where(~F.col("source").isin(p.failed)).withColumn("ord", place(rank))
    keys = stored(identity_keys(batch))

    # what is settled before the rows are looked at one after the other
    why = sellers.rejection_reason(F.col("seller_type"), F.col("level"))
    bad = batch.where(why.isNotNull() & (why != "business_ambiguous")).select("source", "source_id")
    tied = matching.tied_to(keys, bad).withColumn("tied", F.lit(True))
    known = sources.select("source", F.lit(True).alias("established"))
    seen = state.read("seen").select("source", "source_id").distinct().withColumn("seen", F.lit(True))
    live = stored(state.current("holds").where("state = 'held'"))
    waits = live.select("source", "source_id", F.lit(True).alias("waits"))
    marked = batch.join(tied, ["source", "source_id"], "left").join(known, "source", "left").join(seen, ["source", "source_id"], "left").join(waits, ["source", "source_id"], "left")
    outcome = F.when(~F.coalesce("accepted", F.lit(False)), "filtered").when(F.col("tied"), "peer_rejected").when(F.col("established").isNull(), "baseline").when(F.col("seen"), "seen").when(F.col("waits"), "held")
    own = provenance(marked).withColumn("assessment", sellers.assessment(F.col("seller_type"), F.col("level"))["state"])
    marked = stored(own.select("pos", "ord", "source", "source_id", "published_at", "refreshed_at", "needs_check", "assessment", F.col("external_name").alias("origin"), "external_id", outcome.alias("outcome")).withColumnRenamed("external_id", "origin_id"))

    # held rows and open ones in one order
    columns = ["pos", "ord", "source", "source_id", "published_at", "refreshed_at", "needs_check", "assessment", "origin", "origin_id"]
    held = live.withColumns({"ord": place(F.lit(0)), "needs_check": F.lit(True)}).select(*columns, F.lit(True).alias("hold"), "release_at")
    fresh_rows = marked.where("outcome is null").select(*columns, F.lit(False).alias("hold"), F.lit(None).cast("timestamp_ntz").alias("release_at"))
    answered = held.unionByName(fresh_rows).join(replies.select("pos", "cached", "check", "send"), "pos", "left").join(sources, "source", "left")
    boundary = fresh.monitoring_boundary(F.when(~F.col("hold"), F.col("complete_at")), F.col("established_at"), cutover_at)
    kind = fresh.freshness(F.col("published_at"), F.col("refreshed_at"), now, boundary, interval(rules.max_age), interval(rules.grace))
    check = F.when(F.col("needs_check"), F.coalesce("check", F.lit("unresolved"))).otherwise("allow")
    row_keys = stored(live.select(place(F.lit(0)).alias("ord"), F.explode("keys").alias("key")).union(fresh_rows.join(keys, "pos").select("ord", "key")))
    twins = row_keys.join(state.read("identities").select("key").distinct(), "key", "left_semi").select("ord").distinct().withColumn("known", F.lit(True))
    rows = answered.withColumns({"kind": kind, "verdict": check, "fetch": F.col("needs_check") & ~F.coalesce("cached", F.lit(False))}).withColumn("deliverable", fresh.deliverable(F.col("kind"), strict=True))
    rows = stored(rows.join(twins, "ord", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("established_at", "complete_at", "poll"))

    def met(end: int | None) -> tuple[DataFrame, DataFrame]:
        """Rows that are enqueued if no seller is looked up after `end`, and rows that share a key with one enqueued before them."""
        allowed = "deliverable and not known and verdict = 'allow'" + ("" if end is None else f" and (not fetch or ord <= {end})")
        kept = matching.first_come(rows.where(allowed).select("ord").join(row_keys, "ord").select(F.col("ord").alias("pos"), "key")).withColumnRenamed("pos", "ord")
        taken = kept.join(row_keys, "ord").select("key", F.col("ord").alias("of"))
        return kept.withColumn("kept", F.lit(True)), row_keys.join(taken, "key").where("of < ord").select("ord").distinct().withColumn("met", F.lit(True))

    kept, later = met(None)
    looked_up = rows.where("fetch").join(later, "ord", "left").where("hold or (deliverable and not known and met is null)")
    end = _threshold(looked_up, rules.checks, F.col("verdict") == "rate_limited")
    if end is not None:
        kept, later = met(end)
    verdict = F.col("verdict") if end is None else F.when(F.col("fetch") & (F.col("ord") > end), "unresolved").otherwise(F.col("verdict"))
    gate = F.when(F.col("hold") & (verdict == "reject"), "hold_rejected").when(F.col("hold") & (verdict != "allow"), F.when(now >= F.col("release_at"), "hold_expired").otherwise("hold_kept"))
    told = F.coalesce(gate, F.when(F.col("known") | F.col("met"), "duplicate").when(~F.col("deliverable"), F.col("kind")).when(verdict == "reject", "rejected_seller").when(verdict != "allow", "held").otherwise("enqueued"))
    settled = stored(rows.join(later, "ord", "left").withColumn("outcome", told))

    owed = state.current("outbox").where("status in ('pending', 'failed')").orderBy("ord").limit(rules.retries).join(replies.select("pos", "send"), "pos", "left")
    first = settled.where("outcome = 'enqueued'").withColumn("attempts", F.lit(0))
    message = ["pos", "ord", "source", "source_id", "attempts", "assessment", "origin", "origin_id", F.coalesce("send", F.lit("error")).alias("send")]
    sent = _sent(stored(owed.select(*message, F.lit(True).alias("again")).unionByName(first.select(*message, F.lit(False).alias("again")))))
    sent = stored(sent.where("not (again and status = 'pending')").withColumn("attempts", F.when(F.col("status") == "pending", F.col("attempts")).otherwise(F.col("attempts") + 1)))
    result = F.when(F.col("again"), F.when(F.col("status") == "sent", "retried").otherwise("retry_failed")).otherwise(F.when(F.col("status") == "sent", "delivered").when(F.col("status") == "failed", "delivery_failed").otherwise("queued"))

    done = settled.where("outcome not in ('held', 'hold_kept')").unionByName(marked.where("outcome = 'baseline'"), allowMissingColumns=True)
    holds = settled.where("outcome = 'held'").select("pos", "ord", *columns[2:6], *columns[7:]).join(row_keys.groupBy("ord").agg(F.collect_list("key").alias("keys")), "ord")  # some five keys a row
    holds = holds.withColumns({"state": F.lit("held"), "release_at": now + interval(rules.hold)})
    ended = settled.where("hold and outcome <> 'hold_kept'").withColumns({"state": F.col("outcome"), "keys": F.lit(None).cast("array<string>")})
    polled = batch.select("source").distinct().join(sources, "source", "left")
    whole = ~F.col("source").isin(p.degraded)
    state.commit(
        p.number,
        {
            "seen": done.select("pos", "source", "source_id"),
            "identities": first.select("ord", "source", "source_id").join(row_keys, "ord"),
            "decisions": marked.where("outcome is not null").select("pos", "outcome").union(settled.where("outcome <> 'enqueued'").select("pos", "outcome")).union(sent.select("pos", result)),
            "outbox": sent,
            "holds": holds.unionByName(ended, allowMissingColumns=True),
            "sources": polled.select("source", F.coalesce("established_at", now).alias("established_at"), F.when(whole, now).otherwise(F.col("complete_at")).alias("complete_at")),
            "settings": spark.range(0 if cutover else 1).select(F.lit("policy_cutover").alias("name"), now.alias("value")),
        },
    )


#: The polls of the query: which rows a poll shows, and the poll. The numbers have a gap.
POLLS = [
    ("pos % 3 = 0", Poll(1, "1997-06-01 00:00:00")),
    ("pos % 4 <> 2 or pos % 5 = 0", Poll(2, "1998-01-01 00:00:00", failed=["rieltor"], degraded=["lun"])),
    ("pos % 7 <> 3", Poll(4, "1998-09-01 00:00:00")),
    ("pos >= 0", Poll(5, "1999-04-01 00:00:00")),
]
RULES = Rules("interval 1000 days", "interval 120 days", "interval 300 days", checks=25, retries=20)
#: What the sites and the channel answer to poll {n}, in the SQL of both engines.
_REPLIES = """SELECT o_orderkey AS pos, o_orderkey % 16 IN (1, 3) AS cached,
  CASE WHEN {n} = 5 AND o_orderkey % 101 = 7 THEN 'rate_limited' WHEN o_orderkey % 5 = 0 THEN 'unresolved' WHEN (o_orderkey + {n}) % 7 = 0 THEN 'reject' WHEN (o_orderkey + {n}) % 9 = 0 THEN 'unresolved' ELSE 'allow' END AS check,
  CASE WHEN {n} = 4 AND o_orderkey % 89 = 5 THEN 'rate_limited' WHEN (o_orderkey + {n}) % 6 = 0 THEN 'error' ELSE 'ok' END AS send FROM {orders}"""
_CHECKED = "pos % 8 IN (1, 3, 4)"


def _fold_sql(name: str, nodes: str) -> str:
    """Of `nodes` (ord), in order, those that share no key with one kept before: rounds until all are decided."""
    return f"""{name}_adj AS MATERIALIZED (SELECT DISTINCT a.ord AS p, b.ord AS q FROM {nodes} a JOIN rk{name[1:]} ka ON ka.ord = a.ord JOIN rk{name[1:]} kb ON kb.key = ka.key AND kb.ord < ka.ord JOIN {nodes} b ON b.ord = kb.ord),
{name}_r AS (SELECT 0 AS i, ord, CASE WHEN ord NOT IN (SELECT p FROM {name}_adj) THEN true END AS kept FROM {nodes}
  UNION ALL SELECT i + 1, ord, coalesce(kept, d) FROM (SELECT r.i, r.ord, any_value(r.kept) AS kept, CASE WHEN coalesce(bool_or(x.kept), false) THEN false WHEN count(a.q) = count(x.kept) THEN true END AS d
    FROM {name}_r r LEFT JOIN {name}_adj a ON a.p = r.ord LEFT JOIN {name}_r x ON x.ord = a.q GROUP BY r.i, r.ord) WHERE EXISTS (SELECT 1 FROM {name}_r WHERE kept IS NULL)),
{name} AS MATERIALIZED (SELECT ord FROM {name}_r WHERE kept AND i = (SELECT max(i) FROM {name}_r))"""


def _poll_sql(i: int) -> str:
    """The tables after the i-th poll from those after the one before, each under the poll's place."""
    (part, p), q = POLLS[i], i - 1
    ok = f"source NOT IN ({', '.join(map(repr, p.failed)) or repr('')})"
    before = POLLS[:i]
    complete = ", ".join(f"('{s}', TIMESTAMP '{max((x.now for _, x in before if s not in x.failed + x.degraded), default=p.now)}')" for s in ORDER)
    at, base = f"TIMESTAMP '{p.now}'", p.number * 10 * _STEP
    old = "(SELECT NULL::BIGINT AS pos WHERE false)"
    seen, ident, live, owed = (f"{n}{q}" if i else None for n in ("seen", "ident", "live", "out"))
    return f"""
b{i} AS MATERIALIZED (SELECT *, {base} + list_position({ORDER!r}, source) * {_STEP} + pos AS ord FROM fl WHERE ({part}) AND {ok}),
rep{i} AS ({plain(_REPLIES).replace('{n}', str(p.number))}),
tied{i} AS MATERIALIZED (SELECT DISTINCT a.pos FROM k a JOIN b{i} x ON x.pos = a.pos JOIN k b ON b.key = a.key AND (a.source <> b.source OR a.source_id <> b.source_id) JOIN b{i} y ON y.pos = b.pos WHERE 'explicit_external' IN (a.key_class, b.key_class) AND y.bad),
e{i} AS MATERIALIZED (SELECT *, CASE WHEN NOT coalesce(accepted, false) THEN 'filtered' WHEN pos IN (SELECT pos FROM tied{i}) THEN 'peer_rejected' WHEN {'true' if i == 0 else 'false'} THEN 'baseline' WHEN pos IN (SELECT pos FROM {seen or old}) THEN 'seen' WHEN pos IN (SELECT pos FROM {live or old}) THEN 'held' END AS early FROM b{i}),
u{i} AS (SELECT pos, ord, false AS hold, NULL::TIMESTAMP AS release_at, {_CHECKED} AS checked FROM e{i} WHERE early IS NULL{f' UNION ALL SELECT pos, {base} + pos, true, release_at, true FROM {live}' if live else ''}),
w{i} AS MATERIALIZED (SELECT u.*, fl.source, fl.published_at AS pub, fl.refreshed_at AS ref, CASE WHEN checked THEN rep."check" ELSE 'allow' END AS verdict, checked AND NOT cached AS lookup, send,
  CASE WHEN u.hold THEN TIMESTAMP '{POLLS[0][1].now}' ELSE c.since END AS bnd FROM u{i} u JOIN fl ON fl.pos = u.pos JOIN rep{i} rep ON rep.pos = u.pos JOIN (VALUES {complete}) c(source, since) ON c.source = fl.source),
rk{i} AS MATERIALIZED (SELECT w.ord, k.key FROM w{i} w JOIN k ON k.pos = w.pos),
f{i} AS MATERIALIZED (SELECT *, CASE WHEN pub IS NULL THEN 'first_noticed' WHEN pub < {at} - INTERVAL 1000 DAYS THEN CASE WHEN ref >= {at} - INTERVAL 1000 DAYS THEN 'refreshed_old' ELSE 'old_publication' END WHEN pub < bnd AND pub < {at} - INTERVAL 120 DAYS THEN 'late_discovered' ELSE 'new_publication' END AS kind,
  ord IN (SELECT ord FROM rk{i} WHERE key IN (SELECT key FROM {ident or "(SELECT '' AS key)"})) AS known FROM w{i}),
n{i} AS MATERIALIZED (SELECT ord FROM f{i} WHERE kind = 'new_publication' AND NOT known AND verdict = 'allow'),
{_fold_sql(f'g{i}', f'n{i}')},
m{i} AS MATERIALIZED (SELECT DISTINCT a.ord FROM rk{i} a JOIN rk{i} b ON a.key = b.key AND b.ord < a.ord WHERE b.ord IN (SELECT ord FROM g{i})),
look{i} AS MATERIALIZED (SELECT ord, verdict, row_number() OVER (ORDER BY ord) AS n FROM f{i} WHERE lookup AND (hold OR (kind = 'new_publication' AND NOT known AND ord NOT IN (SELECT ord FROM m{i})))),
end{i} AS MATERIALIZED (SELECT coalesce(min(ord), 9000000000000000000) AS stop FROM look{i} WHERE n = {RULES.checks} OR verdict = 'rate_limited'),
v{i} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN lookup AND ord > (SELECT stop FROM end{i}) THEN 'unresolved' ELSE verdict END AS verdict) FROM f{i}),
o{i} AS MATERIALIZED (SELECT ord FROM v{i} WHERE kind = 'new_publication' AND NOT known AND verdict = 'allow'),
{_fold_sql(f'h{i}', f'o{i}')},
z{i} AS MATERIALIZED (SELECT *, CASE WHEN hold AND verdict = 'reject' THEN 'hold_rejected' WHEN hold AND verdict <> 'allow' AND {at} >= release_at THEN 'hold_expired' WHEN hold AND verdict <> 'allow' THEN 'hold_kept'
  WHEN known OR ord IN (SELECT a.ord FROM rk{i} a JOIN rk{i} b ON a.key = b.key AND b.ord < a.ord WHERE b.ord IN (SELECT ord FROM h{i})) THEN 'duplicate' WHEN kind <> 'new_publication' THEN kind WHEN verdict = 'reject' THEN 'rejected_seller' WHEN verdict <> 'allow' THEN 'held' ELSE 'enqueued' END AS outcome FROM v{i}),
s{i} AS MATERIALIZED (SELECT pos, ord, send, false AS again, 0 AS attempts FROM z{i} WHERE outcome = 'enqueued'{f" UNION ALL SELECT * FROM (SELECT o.pos, o.ord, rep.send, true, o.attempts FROM {owed} o JOIN rep{i} rep ON rep.pos = o.pos WHERE status <> 'sent' ORDER BY o.ord LIMIT {RULES.retries})" if owed else ''}),
t{i} AS MATERIALIZED (SELECT *, CASE WHEN ord > (SELECT coalesce(min(ord), 9000000000000000000) FROM s{i} WHERE send = 'rate_limited') THEN 'pending' WHEN send = 'ok' THEN 'sent' ELSE 'failed' END AS status FROM s{i}),
out{i} AS MATERIALIZED (SELECT pos, ord, status, attempts + CAST(status <> 'pending' AS INT) AS attempts FROM t{i} WHERE NOT (again AND status = 'pending'){f" UNION ALL SELECT * FROM {owed} WHERE pos NOT IN (SELECT pos FROM t{i} WHERE status <> 'pending')" if owed else ''}),
seen{i} AS MATERIALIZED (SELECT pos FROM e{i} WHERE early = 'baseline' UNION ALL SELECT pos FROM z{i} WHERE outcome NOT IN ('held', 'hold_kept'){f' UNION ALL SELECT pos FROM {seen}' if seen else ''}),
ident{i} AS MATERIALIZED (SELECT key FROM rk{i} WHERE ord IN (SELECT ord FROM z{i} WHERE outcome = 'enqueued'){f' UNION SELECT key FROM {ident}' if ident else ''}),
live{i} AS MATERIALIZED (SELECT pos, {at} + INTERVAL 300 DAYS AS release_at FROM z{i} WHERE outcome = 'held'{f" UNION ALL SELECT pos, release_at FROM z{i} WHERE outcome = 'hold_kept'" if live else ''}),
dec{i} AS MATERIALIZED (SELECT pos, early AS outcome FROM e{i} WHERE early IS NOT NULL UNION ALL SELECT pos, outcome FROM z{i} WHERE outcome <> 'enqueued' UNION ALL
  SELECT pos, CASE WHEN again AND status = 'sent' THEN 'retried' WHEN again THEN 'retry_failed' WHEN status = 'sent' THEN 'delivered' WHEN status = 'failed' THEN 'delivery_failed' ELSE 'queued' END FROM t{i} WHERE NOT (again AND status = 'pending'))"""


_RECURSIVE = KEYS.replace("GROUP BY ALL", "GROUP BY pos, source, source_id, key").replace("WITH ", "WITH RECURSIVE ", 1).replace("k AS (SELECT", "k AS MATERIALIZED (SELECT")
_CYCLE = (
    _RECURSIVE + "," + _GEO + "," + _CLS.replace("{src}", "d")
    + """, fl AS MATERIALIZED (SELECT *, reason = 'ok' AND km <= 60 AND period IS DISTINCT FROM 'day' AND property_type IN ('apartment', 'house') AND why_not IS NULL AS accepted, why_not IN ('conflict', 'intermediary', 'agent', 'business') AS bad FROM rj),"""
    + ",".join(map(_poll_sql, range(len(POLLS))))
)
_LAST = len(POLLS) - 1
_ASSESSED = """CASE WHEN seller_type = 'owner' AND level = 'platform_confirmed' THEN 'confirmed_owner' WHEN seller_type IN ('agent', 'business') OR level IN ('conflict', 'intermediary') THEN 'confirmed_agent' WHEN level = 'self_declared' THEN 'likely_owner' ELSE 'unknown' END"""


_DONE: dict[tuple[str, str], str] = {}


def _polled(spark: SparkSession, sf: str) -> CycleState:
    """The state after the polls of the queries, the last one run twice; made once an application and folder, and read by each of them."""
    made = (spark.sparkContext.applicationId, sf)
    if made in _DONE:
        return CycleState(spark, _DONE[made])
    spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    flags = flagged(spark, sf).withColumn("accepted", F.coalesce(F.expr("location_ok and property_ok and seller_ok"), F.lit(False))).select("pos", "accepted", "seller_type", "level")
    rows = stored(listings(spark, sf).join(flags, "pos").withColumn("needs_check", F.expr(_CHECKED)))
    path = scratch(spark, "cycle")
    for part, one in [*POLLS, POLLS[-1]]:
        poll(CycleState(spark, path), one, rows.where(part), bound(spark, sf, _REPLIES.replace("{n}", str(one.number))), RULES)
    _DONE[made] = path
    return CycleState(spark, path)


@query(_CYCLE + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT pos, {p.number} AS poll, outcome FROM dec{i}" for i, (_, p) in enumerate(POLLS)) + ")")
def cycle_poll(spark, sf):
    """Every decision of four polls: the first is the silent baseline; in the second a source fails and one is read in part; messages fail, are
    repeated and wait for the channel; sellers' lookups are bounded and stopped; holds end by a verdict or their deadline; the last poll is run twice."""
    return _polled(spark, sf).read("decisions").select("pos", "poll", "outcome")


@query(
    _CYCLE + f", e AS MATERIALIZED (SELECT pos, platform, external FROM (SELECT l.pos, CASE WHEN x.en IS NOT NULL THEN x.en END AS platform, x.ei AS external FROM fl l JOIN x ON x.pos = l.pos)) "
    f"SELECT o.pos, o.status, o.attempts, {_ASSESSED} AS assessment, e.platform AS origin, e.external AS origin_id FROM out{_LAST} o JOIN fl ON fl.pos = o.pos JOIN e ON e.pos = o.pos".replace(", e AS MATERIALIZED", ", ee AS MATERIALIZED").replace("JOIN e ON e.pos", "JOIN ee e ON e.pos")
)
def cls24_cycle_outbox(spark, sf):
    """The outbox after the polls: each message's status, attempts, and what the listing was annotated with when it was enqueued."""
    return _polled(spark, sf).current("outbox").select("pos", "status", "attempts", "assessment", "origin", "origin_id")


@query(
    f"SELECT * FROM (VALUES {', '.join(str((s, POLLS[0][1].now, max(p.now for _, p in POLLS if s not in p.failed + p.degraded))) for s in ORDER)}) t(source, established_at, complete_at)"
    f" WHERE source IN (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'domria' WHEN 1 THEN 'lun' WHEN 2 THEN 'rieltor' ELSE 'olx' END FROM orders WHERE o_orderkey % 3 = 0)"
)
def str5_ups12_cycle_boundaries(spark, sf):
    """When each source was established and last read completely: failed and partial polls do not move it; rows of one source after the first two polls say so."""
    rows = _polled(spark, sf).current("sources")
    return rows.select("source", F.col("established_at").cast("string").alias("established_at"), F.col("complete_at").cast("string").alias("complete_at"))
