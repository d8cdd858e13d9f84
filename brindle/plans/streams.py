"""Queries over streams: alerts, cached verdicts, appended traces, heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators.decisions import VERDICT_HOURS
from brindle.plans.base import query, scratch, table
from brindle.plans.stateful import _stream
from brindle.sources.traces import TraceSink, appended
from brindle.streaming import alerts, heartbeat
from brindle.streaming.stateful import run_to_end

_DELAY_DAYS = 9
_FAILS = "event_type IN ('error', 'signup')"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 40 AS key, epoch_us(ts) // 1000 AS made, NOT {_FAILS} AS ok, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT max(epoch_us(ts) // 1000) - {_DELAY_DAYS} * 86400000 AS mark FROM events),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, 0::BIGINT AS streak, false AS opened, -1::BIGINT AS until, NULL::BIGINT AS told, NULL::VARCHAR AS kind, NULL::BOOLEAN AS sent FROM e
  UNION ALL SELECT key, n, streak, CASE WHEN tries AND good THEN want = 'incident' ELSE opened END, CASE WHEN tries AND NOT good THEN t + {alerts.COOLDOWN_MS} WHEN due OR until < 0 THEN -1 ELSE until END, CASE WHEN tries THEN t END, CASE WHEN tries THEN want END, CASE WHEN tries THEN good END
  FROM (SELECT *, want IS NOT NULL AND (due OR until < 0) AS tries, (t // 1000) % 7 >= 4 AS good FROM (SELECT *, CASE WHEN streak >= 3 AND NOT opened THEN 'incident' WHEN streak = 0 AND opened THEN 'recovery' END AS want
    FROM (SELECT f.key, f.opened, f.until, coalesce(f.until >= 0 AND f.until <= coalesce(e.made, w.mark), false) AS due, CASE WHEN due THEN f.n ELSE f.n + 1 END AS n, CASE WHEN due THEN f.streak WHEN e.ok THEN 0 ELSE f.streak + 1 END AS streak, CASE WHEN due THEN f.until ELSE e.made END AS t, e.n AS next
      FROM f LEFT JOIN e ON e.key = f.key AND e.n = f.n + 1 CROSS JOIN w) WHERE due OR next IS NOT NULL)))
SELECT key, told AS "at", kind, sent FROM f WHERE told IS NOT NULL"""
)
def stream_ups14_jn12_alerts(spark, sf):
    """Alerts of every source: one an incident, one when it is over; those that fail are tried again six hours later, by a timer if nothing else comes."""
    rows = table(spark, sf, "events").selectExpr("user_id % 40 as key", "unix_millis(cast(ts as timestamp)) as at", "event_id as tie", f"not {_FAILS} as ok", "ts")
    stream = _stream(spark, sf, rows, "key").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_end(alerts.source_alerts(stream, alerts.deadline_sends, "ts", f"{_DELAY_DAYS} days"), scratch(spark, "stream"))


_CLASS = "CASE event_type WHEN 'purchase' THEN 'confirmed_owner' WHEN 'error' THEN 'temporary_failure' WHEN 'signup' THEN 'confirmed_intermediary' ELSE 'unknown' END"
_LASTS = "CASE verdict " + " ".join(f"WHEN '{v}' THEN {h * 3_600_000}" for v, h in VERDICT_HOURS.items()) + " ELSE 60000 END"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS key, event_id AS tie, event_id % 3 AS id, epoch_us(ts) // 1000 AS made, {_CLASS} AS verdict, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f AS (SELECT key, id, n, tie, verdict, made + {_LASTS} AS until, false AS cached FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.id, e.n, e.tie, CASE WHEN f.until > e.made THEN f.verdict ELSE e.verdict END, CASE WHEN f.until > e.made THEN f.until ELSE e.made + {_LASTS.replace('verdict', 'e.verdict')} END, f.until > e.made FROM f JOIN e ON e.key = f.key AND e.id = f.id AND e.n = f.n + 1)
SELECT key, tie, verdict, cached FROM f"""
)
def stream_ups7_verdict_cache(spark, sf):
    """Verdicts kept for as long as their class lasts; one that has run out is looked up again."""
    rows = table(spark, sf, "events").selectExpr("user_id as key", "event_id % 3 as id", "unix_millis(cast(ts as timestamp)) as at", "event_id as tie", f"{_CLASS} as verdict", "ts")
    stream = _stream(spark, sf, rows, "key").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_end(alerts.cached_verdicts(stream, "ts", f"{_DELAY_DAYS} days"), scratch(spark, "stream"))


@query("SELECT event_id, left(event_type, 3) AS clipped, ts FROM events WHERE user_id % 10 <> 0")
def snk7_snk2_trace_stream(spark, sf):
    """Traces appended by a stream with a two-step commit; all batches are run twice, from a checkpoint that knows nothing of the first time, and count once."""
    rows = table(spark, sf, "events").withColumn("id", F.when(F.expr("user_id % 10 = 0"), "  ").otherwise(F.col("user_id").cast("string"))).select("event_id", "id", "event_type", "ts")
    traces = _stream(spark, sf, rows, "event_id").where("trim(id) <> ''").select("event_id", F.left("event_type", F.lit(3)).alias("clipped"), "ts")
    path = scratch(spark, "traces")
    spark.dataSource.register(TraceSink)
    for attempt in ("first", "second"):
        traces.writeStream.format("trace_sink").option("path", path).option("checkpointLocation", f"{scratch(spark, 'checkpoint')}-{attempt}").trigger(availableNow=True).start().awaitTermination()
    return appended(spark, path, traces.schema)


_PERIODS = ["2000-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "2100-01-01"]


@query("SELECT " + "CASE " + " ".join(f"WHEN ts < TIMESTAMP '{d}' THEN {i}" for i, d in enumerate(_PERIODS[1:])) + ' END::BIGINT AS batch, count(*) AS "rows" FROM events GROUP BY ALL')
def snk6_heartbeat(spark, sf):
    """A line a batch, written by a listener of the stream's progress and read back."""
    path, beats = scratch(spark, "files"), scratch(spark, "beats")
    rows = table(spark, sf, "events").select("event_id", "ts")
    for start, end in zip(_PERIODS, _PERIODS[1:]):
        rows.where(f"ts >= timestamp_ntz '{start}' and ts < timestamp_ntz '{end}'").coalesce(1).write.mode("append").parquet(path)
    listener = heartbeat.Heartbeat(spark, beats)
    spark.streams.addListener(listener)
    run_to_end(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), scratch(spark, "stream"))
    listener.ended.wait(60)
    spark.streams.removeListener(listener)
    return spark.read.schema("query string, batch bigint, rows bigint").json(beats).where("rows > 0").select("batch", "rows")
