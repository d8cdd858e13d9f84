"""Queries over sources and sinks: pages and JSON in, tables and messages out."""

from __future__ import annotations

from pyspark.sql import functions as F


from brindle.operators.state import inserted_or_ignored
from brindle.plans.base import L, bound, listings, query, scratch, table
from brindle.sources import pages as src

_PROPS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{{\"id\":' || CAST(event_id AS STRING) || ',\"title\":\"T' || event_type || '\",\"price\":{{\"amount\":' || CAST(user_id AS STRING) || ',\"currency\":\"UAH\"}}}}' WHEN 1 THEN '{{\"title\":\"no id\"}}' WHEN 2 THEN '{{\"id\":\"' || CAST(event_id AS STRING) || '\",\"title\":\"  \"}}' WHEN 3 THEN '{{broken' WHEN 4 THEN props END AS raw, event_type, user_id FROM {events}".replace("{{", "{").replace("}}", "}")
_REJECT = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no_id' WHEN 2 THEN 'no_title' WHEN 3 THEN 'bad_json' WHEN 4 THEN 'no_id' ELSE 'bad_json' END"


@query(f"SELECT event_id, {_REJECT} AS reject_reason FROM events")
def src3_bad_records(spark, sf):
    return src.parsed_offers(bound(spark, sf, _PROPS), "raw").select("event_id", "reject_reason")


@query(f"WITH r AS (SELECT event_id, {_REJECT} AS reason FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY event_id) AS k FROM r) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, max(CASE WHEN k <= 40 THEN event_id END) AS last_sample FROM n GROUP BY 1")
def src5_reject_accounting(spark, sf):
    from brindle.operators.ordered import ranked

    rows = ranked(src.parsed_offers(bound(spark, sf, _PROPS), "raw"), ["reject_reason"], ["event_id"])
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.max(F.when(F.col("__rank") <= 40, F.col("event_id"))).alias("last_sample"))


def _state_pages(spark, sf):
    """Pages with a state assignment built in: braced, quoted, cut off, or none."""
    ads = F.concat(F.lit('{"listing":{"listing":{"pageNumber":0,"totalPages":3,"ads":[{"id":'), F.col("page_id").cast("string"), F.lit(',"title":"a } b \\" {"}]}}}'))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(ads, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.when(F.expr("page_id % 4 = 0"), ads).when(F.expr("page_id % 4 = 1"), quoted).when(F.expr("page_id % 4 = 2"), F.left(ads, F.lit(40)))
    page = F.concat(F.lit("<html><script>window.__STATE__ = "), body, F.lit(";</script>"), F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.coalesce(page, F.col("html")).alias("html"))


@query("SELECT page_id, page_id % 4 <> 3 AND page_id % 4 <> 2 AS present, page_id % 4 < 2 AS complete, CASE WHEN page_id % 4 < 2 THEN page_id END AS ad_id, CASE WHEN page_id % 4 < 2 THEN 1 END AS page_no FROM pages")
def src6_src7_src8_src9_embedded_state(spark, sf):
    """State blobs by a scanner that balances braces outside of strings, decoded, with the page's header from 0-based to 1-based."""
    s = src.decoded_state(src.state_column(F.col("html"), "__STATE__"))
    rows = _state_pages(spark, sf).select("page_id", s.alias("s"))
    ad = F.try_variant_get("s.value", "$.listing.listing.ads[0].id", "bigint")
    number = F.try_variant_get("s.value", "$.listing.listing.pageNumber", "int")
    return rows.select("page_id", "s.present", "s.complete", ad.alias("ad_id"), F.when(number >= 0, number + 1).alias("page_no"))


@query("SELECT p_partkey AS part, CAST(p_partkey AS STRING) AS id, p_brand AS title, 2 AS depth FROM part UNION ALL SELECT p_partkey, 'x' || CAST(p_size AS STRING), 'inner', 4 FROM part")
def src10_deep_walk(spark, sf):
    raw = F.to_json(F.struct(F.array(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.struct(F.struct(F.concat(F.lit("x"), "p_size").alias("id"), F.lit("inner").alias("title")).alias("deep")).alias("more"))).alias("items")))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), raw.alias("raw"))
    return rows.lateralJoin(src.OfferLike(F.col("raw").outer(), F.lit(50))).select("part", "id", "title", "depth")


@query(r"SELECT page_id, nullif(regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1), '') AS script, len(regexp_extract_all(html, '<script', 0)) AS n_scripts, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def src11_src28_script_inventory(spark, sf):
    script = F.nullif(F.regexp_extract("html", "(?s)<script[^>]*>(.*?)</script>", 1), F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("bigint")
    return table(spark, sf, "pages").select("page_id", script.alias("script"), count("<script").alias("n_scripts"), count('href="([^"]*)"').alias("n_links"))


@query("SELECT page_id, 0 AS pos, 'a' || chr(10) || CAST(page_id AS STRING) AS payload FROM pages UNION ALL SELECT page_id, 1, 'q\"' FROM pages")
def src13_pushed_payloads(spark, sf):
    stream = F.concat(F.lit('x.push([1,"a\\n'), F.col("page_id").cast("string"), F.lit('"]);push([0,"no"]);x.push([1,"q\\""])'))
    return table(spark, sf, "pages").select("page_id", F.posexplode(src.pushed_payloads(stream)).alias("pos", "payload"))


@query("SELECT page_id, 'u' || CAST(page_id % 3 AS STRING) AS url, 'second' AS name FROM pages")
def src15_json_ld_by_url(spark, sf):
    """Items by URL; of items with the same URL the last wins."""
    item = lambda name: F.concat(F.lit('<script type="application/ld+json">{"url":"u'), F.expr("cast(page_id % 3 as string)"), F.lit(f'","name":"{name}"}}</script>'))
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.col("html"), item("first"), item("second")).alias("html"))
    items = pages.select("page_id", F.posexplode(src.json_ld(F.col("html"))).alias("pos", "raw")).withColumn("i", F.from_json("raw", "url string, name string"))
    return items.groupBy("page_id", "i.url").agg(F.max_by("i.name", "pos").alias("name")).select("page_id", "url", "name")


@query(r"SELECT page_id, u.i AS pos, regexp_extract(u.c, 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, string_split(split_part(html, '<article>', 1), '<li>')[2:] AS cs FROM pages), unnest(list_transform(cs, lambda c, i: {'c': c, 'i': i - 1})) t(u)")
def src18_card_slices(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(src.cards(F.col("html"), "<li>", "<article>")).alias("pos", "card"))
    return rows.select("page_id", "pos", F.coalesce(src.attribute(F.col("card"), "href"), F.lit("")).alias("href"))


_BODIES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<html>no</html>' WHEN 2 THEN '{\"count\":2,\"items\":[' || CAST(event_id AS STRING) || ',\"x\"]}' WHEN 3 THEN '{\"count\":0,\"items\":[]}' ELSE '{\"count\":1}' END AS body FROM {events}"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'html' WHEN 4 THEN 'missing_items' ELSE 'ids' END AS shape, CASE event_id % 5 WHEN 2 THEN CAST(event_id AS STRING) || ',x' WHEN 3 THEN '' END AS ids FROM events")
def src24_body_shape(spark, sf):
    """A missing list is another thing than an empty one."""
    items = F.try_variant_get(F.try_parse_json("body"), "$.items", "array<string>")
    shape = F.when(F.trim("body") == "", "empty").when(F.col("body").startswith("<"), "html").when(F.try_parse_json("body").isNull(), "bad_json").when(items.isNull(), "missing_items").otherwise("ids")
    return bound(spark, sf, _BODIES).select("event_id", shape.alias("shape"), F.array_join(items, ",").alias("ids"))


@query("SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))) AS checksum FROM embeddings")
def src29_json_file_scan(spark, sf):
    """A round trip through JSON lines: written to the shared folder, read with a declared schema."""
    path = scratch(spark, "json")
    table(spark, sf, "embeddings").write.json(path)
    rows = spark.read.schema("vec_id bigint, label int, embedding array<float>").json(path)  # the text of a float is that float, but as a double it is another number
    numbers = "filter(embedding, x -> x is not null)"
    return rows.select("vec_id", "label", F.expr(f"if(size({numbers}) > 0, aggregate({numbers}, 0L, (s, x) -> s + cast(round(cast(x as double) * 1000) as bigint)), null)").alias("checksum"))


_OUT = L + ", o AS (SELECT * FROM l WHERE pos % 7 = 3), n AS (SELECT * FROM l WHERE pos % 7 <> 3 AND pos % 5 = 0) "


@query(_OUT + "SELECT pos, 'sent' AS status FROM o UNION ALL SELECT pos, 'pending' FROM n")
def snk1_idempotent_enqueue(spark, sf):
    """Rows already in the outbox are not enqueued again, however often a batch comes."""
    rows = listings(spark, sf)
    outbox = rows.where("pos % 7 = 3").select("pos", F.lit("sent").alias("status"))
    batch = rows.where("pos % 5 = 0").select("pos", F.lit("pending").alias("status"))
    once = inserted_or_ignored(outbox, batch, ["pos"], ["status"])
    return inserted_or_ignored(once, batch, ["pos"], ["status"])


@query("SELECT event_id, left(event_type, 3) AS clipped, ts FROM events WHERE user_id % 10 <> 0")
def snk7_trace_append(spark, sf):
    """Blank ids are skipped, fields are clipped."""
    rows = table(spark, sf, "events").withColumn("id", F.when(F.expr("user_id % 10 = 0"), "  ").otherwise(F.col("user_id").cast("string")))
    return rows.where("trim(id) <> ''").select("event_id", F.left("event_type", F.lit(3)).alias("clipped"), "ts")


@query(L + "SELECT pos, source, published_at, amount FROM l")
def snk10_json_round_trip(spark, sf):
    schema = "pos bigint, source string, published_at timestamp_ntz, amount double"
    rows = listings(spark, sf).select("pos", "source", "published_at", "amount")
    return rows.select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ids, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders")
def snk8_backup_verified(spark, sf):
    """A versioned copy of a table, and the counts that a backup is verified by."""
    path = scratch(spark, "backup")
    table(spark, sf, "orders").write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_ids"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


_CLIP = 200


@query(
    f"WITH p AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN html ELSE 'ї' || html || '😀' || repeat('є', CAST(page_id % 200 AS INT)) END AS body FROM pages) SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes, "
    f"sha256(left(body, coalesce(list_last(list_filter(range(0, {_CLIP} + 1), lambda k: octet_length(encode(left(body, k))) <= {_CLIP})), 0))) AS clip_sha256, octet_length(encode(body)) > {_CLIP} AS clipped FROM p"
)
def snk6_snk9_capture_files(spark, sf):
    """Captures of all pages as JSON lines, each cut to so many bytes and not within a character, read back."""
    body = F.expr("if(page_id % 2 = 0, html, concat('ї', html, '😀', repeat('є', int(page_id % 200))))")
    rows = table(spark, sf, "pages").select("page_id", body.alias("body"))
    path = scratch(spark, "captures")
    rows.select("page_id", F.octet_length("body").alias("n_bytes"), src.clipped(F.col("body"), _CLIP).alias("clip")).write.json(path)
    found = spark.read.schema("page_id bigint, n_bytes bigint, clip string").json(path)
    return found.select("page_id", "n_bytes", F.sha2("clip", 256).alias("clip_sha256"), (F.col("n_bytes") > _CLIP).alias("clipped"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, max(event_id) AS last_id FROM events GROUP BY 1")
def snk6_json_log(spark, sf):
    """Log lines as JSON, a folder a day, and the heartbeat that is read from them."""
    path = scratch(spark, "log")
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_id", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("ts").alias("at"))
    rows.write.partitionBy("day").json(path)
    read = spark.read.schema("event_id bigint, level string, at timestamp_ntz, day date").json(path)
    return read.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("n_errors"), F.max("event_id").alias("last_id"))
