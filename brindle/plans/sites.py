"""Queries over the four sites' pages: built from the orders, read back by the parsers, checked against what they were built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import sellers
from brindle.plans.base import bound, plain, query, table
from brindle.sources import pages, sites

_text = lambda c: f"CAST({c} AS STRING)"
#: Offers, ten to a page, with every way to be no listing.
_ADS = """
SELECT o_orderkey AS pos, CAST(floor(o_orderkey / 10) AS BIGINT) AS page, o_orderkey % 2 = 0 AS camel, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey END AS id,
  CASE WHEN o_orderkey % 19 <> 0 THEN CASE o_orderkey % 7 WHEN 0 THEN 'Подобово квартира ' WHEN 1 THEN 'Гараж ' WHEN 2 THEN 'Кімната ' WHEN 3 THEN 'Кімната у квартирі ' ELSE 'Квартира ' END || CAST(o_orderkey AS STRING) END AS title,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'Львів' END AS city, CASE WHEN o_orderkey % 3 = 0 THEN 'Франківський' END AS district, o_totalprice AS amount, CASE o_orderkey % 4 WHEN 0 THEN 'USD' ELSE 'UAH' END AS currency,
  CASE o_orderkey % 5 WHEN 0 THEN 330 WHEN 1 THEN 99 ELSE 1760 END AS category, CASE WHEN o_orderkey % 6 <> 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day, CASE WHEN o_orderkey % 8 < 6 THEN o_orderkey % 8 < 3 END AS business,
  CASE WHEN o_orderkey % 9 <> 0 THEN 49.8 + CAST(o_orderkey % 10 AS DOUBLE) / 100 END AS lat, CASE WHEN o_orderkey % 11 <> 0 THEN '/d/obyavlenie/ID' || CAST(o_orderkey AS STRING) || '.html' END AS path, o_orderkey % 4 AS n_photos
FROM {orders}
"""
_REASON = lambda category: f"CASE WHEN {'category <> ' + str(category) if category else 'false'} THEN 'wrong_category' WHEN id IS NULL OR title IS NULL THEN 'adapt_failed_missing_id_or_title' WHEN city IS NULL THEN 'missing_city_label' END"


def olx_pages(spark, sf):
    """(page, payload): {"data": [...]} with the page's offers in either spelling of keys, in order."""
    photos = F.expr("slice(array('https://img.example/' || cast(pos as string), 'ftp://img.example/x', 'http://img.example/y'), 1, int(n_photos))")
    named = F.struct(F.col("city").alias("name"))
    camel = F.struct(
        "id", "title", F.concat("day", F.lit("T10:00:00Z")).alias("createdTime"), F.col("business").alias("isBusiness"), F.struct(F.struct(F.col("amount").alias("value"), F.col("currency").alias("currencyCode")).alias("regularPrice")).alias("price"),
        F.struct(F.col("city").alias("cityName"), F.col("district").alias("districtName")).alias("location"), F.struct("lat", F.lit(24.0).alias("lon")).alias("map"), F.struct(F.col("category").alias("id")).alias("category"), F.col("path").alias("urlPath"), photos.alias("photos"),
    )
    param = F.struct(F.lit("price").alias("key"), F.struct(F.col("amount").alias("value"), "currency").alias("value"))
    snake = F.struct(
        F.col("id").cast("string").alias("id"), "title", F.concat("day", F.lit("T10:00:00Z")).alias("created_time"), "business", F.array(F.struct(F.lit("m").alias("key"), F.struct(F.lit(1.0).alias("value"), F.lit("x").alias("currency")).alias("value")), param).alias("params"),
        F.struct(named.alias("city"), F.when(F.col("district").isNotNull(), F.struct(F.col("district").alias("name"))).alias("district")).alias("location"), F.struct("lat", F.lit(24.0).alias("lon")).alias("map"), F.struct(F.col("category").alias("id")).alias("category"),
        F.concat(F.lit("https://www.olx.ua"), "path").alias("url"), F.transform(photos, lambda x: F.struct(x.alias("link"))).alias("photos"),
    )
    rows = bound(spark, sf, _ADS).select("page", "pos", F.when(F.col("camel"), F.to_json(camel)).otherwise(F.to_json(snake)).alias("raw"))
    listed = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("ads"))
    return listed.select("page", F.concat(F.lit('{"data":['), F.array_join("ads", ","), F.lit("]}")).alias("payload"))


def olx_offers(spark, sf, only=None):
    """(page, n, o): an offer is read inside its page's row, so it is a column from there on and no later step reads it again."""
    items = F.try_variant_get(F.try_parse_json("payload"), "$.data", "array<variant>")
    return olx_pages(spark, sf).select("page", F.posexplode(F.transform(items, lambda v: sites.offer(v, only))).alias("n", "o"))


_HOME = "CASE WHEN category NOT IN (1760, 330) OR pos % 7 IN (0, 1, 2) THEN 'unknown' WHEN category = 1760 THEN 'apartment' ELSE 'house' END"


@query(
    f"WITH a AS ({plain(_ADS)}), n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS n, {_REASON(None)} AS reason FROM a) "
    f"SELECT page, n, {_text('id')} AS source_id, title, 'https://www.olx.ua' || coalesce(path, '/d/obyavlenie/-ID' || {_text('id')} || '.html') AS url, concat_ws(', ', city, district) AS place, {_HOME} AS property_type, "
    "CAST(day || ' 10:00:00' AS TIMESTAMP) AS published_at, amount, currency, lat AS latitude, CASE WHEN business THEN 'business' WHEN NOT business THEN 'private' END AS account, CASE n_photos WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS n_images FROM n WHERE reason IS NULL"
)
def src1_src2_src4_fn22_fn24_offers(spark, sf):
    """Pages of offers in both spellings as listings; offers that are none are left out."""
    found = olx_offers(spark, sf).where(sites.offer_reject(F.col("o")).isNull()).select("page", "n", sites.offer_listing(F.col("o")).alias("l"))
    names = ["source_id", "title", "url", "place", "property_type", "amount", "currency", "latitude", "account"]
    return found.select("page", "n", *(f"l.{c}" for c in names), F.col("l.published_at").cast("timestamp_ntz").alias("published_at"), F.coalesce(F.size("l.images"), F.lit(0)).alias("n_images"))


@query(
    f"WITH a AS ({plain(_ADS)}), r AS (SELECT page, coalesce({_REASON(1760)}, 'accepted') AS reason, id, pos FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY page, pos) AS k FROM r) "
    f"SELECT reason, count(*) AS n, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE k <= 40) AS n_samples FROM n GROUP BY reason"
)
def src3_src5_flt10_reject_reasons(spark, sf):
    """What becomes of the offers where one category is expected: reasons in their order, and a bounded number of samples; offers are read once for both."""
    from brindle.operators.ordered import ranked
    from brindle.operators.stored import stored

    rows = stored(olx_offers(spark, sf, sites.JUDGED).select("page", "n", F.col("o.id").alias("id"), F.coalesce(sites.offer_reject(F.col("o"), sites.APARTMENTS), F.lit("accepted")).alias("reason")))
    samples = ranked(rows, ["reason"], ["page", "n"]).where("__rank <= 40").groupBy("reason").agg(F.count("*").alias("n_samples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")).join(samples, "reason")


@query(
    f"WITH a AS ({plain(_ADS)}), l AS (SELECT * FROM a WHERE id IS NOT NULL AND title IS NOT NULL AND city IS NOT NULL), b AS (SELECT id FROM l WHERE business), p AS (SELECT * FROM l WHERE business IS NOT TRUE OR pos % 16 = 0) "
    "SELECT page, count(*) AS n_private, count(*) FILTER (WHERE id IN (SELECT id FROM b)) AS n_leaked FROM p GROUP BY page"
)
def flt11_contract_leaks(spark, sf):
    """The private catalog holds some business accounts' offers, which the business catalog has too: these are dropped and counted."""
    rows = olx_offers(spark, sf).where(sites.offer_reject(F.col("o")).isNull()).select("page", F.col("o.id").alias("id"), F.col("o.business").alias("business"))
    business = rows.where("business").select("id").distinct().withColumn("leaked", F.lit(True))
    private = rows.where("not coalesce(business, false) or cast(id as bigint) % 16 = 0").join(business, "id", "left")
    return private.groupBy("page").agg(F.count("*").alias("n_private"), F.count_if(F.coalesce("leaked", F.lit(False))).alias("n_leaked"))


@query(
    f"WITH a AS ({plain(_ADS)}), p AS (SELECT page, count(*) AS n_raw, count(*) FILTER (WHERE {_REASON(None)} IS NULL) AS n_ok, count(*) FILTER (WHERE id IS NOT NULL AND title IS NOT NULL) AS n_like FROM a GROUP BY page) "
    "SELECT page, CASE page % 4 WHEN 0 THEN 'state' WHEN 1 THEN 'state' WHEN 2 THEN 'next_data' ELSE 'none' END AS method, CASE WHEN page % 4 < 2 THEN n_raw WHEN page % 4 = 2 THEN n_like ELSE 0 END AS n_raw, CASE WHEN page % 4 < 2 THEN n_ok WHEN page % 4 = 2 THEN n_like ELSE 0 END AS n_listings FROM p"
)
def src12_catalog_page(spark, sf):
    """The page's state first, whether braced or quoted; offers found anywhere in its script data where the state is cut off; else nothing."""
    state = F.concat(F.lit('{"listing":{"listing":{"pageNumber":0,"ads":'), F.substring_index("payload", '{"data":', -1), F.lit("}}"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kind = F.col("page") % 4
    script = F.when(kind == 2, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), "payload", F.lit("</script>"))).otherwise("")
    html = F.concat(F.lit("<html><script>window.__STATE__ = "), F.when(kind == 0, state).when(kind == 1, quoted).otherwise(F.left(state, F.lit(60))), F.lit(";</script>"), script)
    read = olx_pages(spark, sf).select("page", html.alias("html")).withColumn("s", pages.decoded_state(pages.state_column(F.col("html"), "__STATE__"))).withColumn("next", pages.script_json(F.col("html"), "__NEXT_DATA__"))
    method = F.when(F.col("s.complete"), "state").when(F.try_parse_json("next").isNotNull(), "next_data").otherwise("none")
    # a page is one row and its offers are counted in it, so that it is read once
    ads = F.try_variant_get("s.value", "$.listing.listing.ads", "array<variant>")
    oks = F.transform(ads, lambda v: sellers.bound(sites.offer(v, sites.JUDGED), lambda o: sites.offer_reject(o).isNull()))
    read = read.select("page", method.alias("method"), oks.alias("oks"), "next")
    read = read.withColumn("walked", pages.offers_like_count(F.when(F.col("method") == "next_data", F.col("next")), 1000))
    counted = lambda c: F.when(F.col("method") == "state", F.coalesce(c, F.lit(0))).otherwise(F.col("walked")).cast("bigint")
    return read.select("page", "method", counted(F.size("oks")).alias("n_raw"), counted(F.size(F.filter("oks", lambda ok: ok))).alias("n_listings"))


# --- cards in pushed payloads ----------------------------------------------------------------------------------------

_CARDS = """
SELECT o_orderkey AS pos, CAST(floor(o_orderkey / 8) AS BIGINT) AS page, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'Оселя ' || CAST(o_orderkey AS STRING) END AS header, o_totalprice AS price,
  CASE o_orderkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'UAH' END AS currency, o_orderkey % 5 AS rooms, CASE WHEN o_orderkey % 7 <> 0 THEN 24.0 + CAST(o_orderkey % 10 AS DOUBLE) / 100 END AS lng, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS section,
  CASE WHEN o_orderkey % 6 <> 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day, o_orderkey % 10 = 3 AS agency, CASE o_orderkey % 9 WHEN 1 THEN 'Rieltor' WHEN 2 THEN 'person' END AS contact, CAST(floor(o_orderkey / 8) AS BIGINT) % 11 AS kind
FROM {orders}
"""


def lun_pages(spark, sf):
    """(page, html): cards in a pushed payload, and JSON-LD items for the first ones; some pages without, cut off or empty."""
    point = F.when(F.col("lng").isNotNull(), F.array(F.col("lng"), F.lit(49.8)))
    card = F.to_json(
        F.struct("id", "header", "price", "currency", F.col("rooms").alias("roomCount"), point.alias("location"), F.col("section").alias("sectionId"), F.concat("day", F.lit("T09:00:00")).alias("insertTime"), F.when(F.col("agency"), F.struct(F.lit(5).alias("id"))).alias("agency"), F.struct(F.col("contact").alias("contactType")).alias("rieltorContact"))
    )
    extra = F.to_json(F.struct(F.concat(F.lit("JSON "), F.col("pos").cast("string")).alias("name"), F.struct(F.lit("Львів").alias("addressLocality"), F.concat(F.lit("вул. "), F.col("pos").cast("string")).alias("streetAddress")).alias("address")))
    rows = bound(spark, sf, _CARDS).withColumn("n", F.expr("pos % 8")).select("page", "kind", "pos", card.alias("card"), F.when(F.col("n") < 3, extra).alias("extra"))
    listed = rows.groupBy("page", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "card", "extra"))).alias("x"))
    cards = F.when(F.col("kind") == 9, "[]").otherwise(F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["card"]), ","), F.lit("]")))
    payload = F.concat(F.lit('5:{"realties":{"cards":'), F.when(F.col("kind") == 8, F.expr("left('[{\"id\":', 5)")).otherwise(cards), F.lit(',"total":1}}'))
    payload = F.when(F.col("kind") == 10, '5:{"other":1}').when(F.col("kind") == 8, F.substring_index(payload, ",", 1)).otherwise(payload)
    pushed = F.concat(F.lit('<script>x.push([1,"'), F.replace(F.replace(payload, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    items = F.array_join(F.filter(F.transform("x", lambda r: r["extra"]), lambda e: e.isNotNull()), ",")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), items, F.lit("]}</script>"))
    return listed.select("page", F.concat(pushed, ld).alias("html"))


def lun_cards(spark, sf):
    """(page, failed, marked, n_raw, cards, extras): the card values that are valid, in order, and the JSON-LD items."""
    read = lun_pages(spark, sf).select("page", "html", sites.card_arrays(F.col("html")).alias("texts"))
    found = read.select("page", F.size("texts").alias("n_marks"), F.explode_outer("texts").alias("t"), "html").withColumn("raw", F.try_parse_json(pages.balanced_column(F.col("t"))))
    cards = F.try_variant_get("raw", "$", "array<variant>")
    extras = F.try_variant_get(F.try_parse_json(pages.json_ld(F.col("html"))[0]), "$.itemListElement", "array<variant>")
    return found.select("page", (F.col("n_marks") > 0).alias("marked"), F.expr("t is not null and raw is null").alias("failed"), F.coalesce(F.size(cards), F.lit(0)).alias("n_raw"), F.filter(cards, sites.card_valid).alias("cards"), extras.alias("extras"))


_READ = "kind NOT IN (8, 9, 10)"
_LUN_KIND = "CASE kind WHEN 8 THEN 'parser_failure' WHEN 10 THEN 'parser_failure' WHEN 9 THEN 'valid_empty' ELSE CASE WHEN n_ok = 0 THEN 'parser_failure' ELSE 'ok' END END"


@query(
    f"WITH c AS ({plain(_CARDS)}), p AS (SELECT page, kind, count(*) FILTER (WHERE {_READ}) AS n_raw, count(id) FILTER (WHERE {_READ}) AS n_ok, count(*) FILTER (WHERE {_READ} AND id IS NOT NULL AND lng IS NULL) AS n_nowhere FROM c GROUP BY page, kind) "
    f"SELECT page, n_raw, n_ok, n_raw - n_ok AS n_rejected, n_nowhere, CASE WHEN n_raw > 0 THEN n_ok / n_raw ELSE 0 END AS ratio, {_LUN_KIND} AS result_kind FROM p"
)
def src13_src14_src17_agg15_card_pages(spark, sf):
    """Pages of cards: counts, and the kind of result: unreadable or unmarked payloads and all-rejected cards are failures, an empty array is none."""
    read = lun_cards(spark, sf).withColumn("n_ok", F.coalesce(F.size("cards"), F.lit(0)))
    nowhere = F.coalesce(F.size(F.filter("cards", lambda c: F.try_variant_get(c, "$.location", "variant").isNull())), F.lit(0))
    kind = F.when(F.col("failed") | ~F.col("marked") | F.expr("n_raw > 0 and n_ok = 0"), "parser_failure").when(F.col("n_raw") == 0, "valid_empty").otherwise("ok")
    return read.select("page", "n_raw", "n_ok", F.expr("n_raw - n_ok").alias("n_rejected"), nowhere.alias("n_nowhere"), F.coalesce(F.try_divide("n_ok", "n_raw"), F.lit(0.0)).alias("ratio"), kind.alias("result_kind"))


@query(
    f"WITH c AS ({plain(_CARDS)}), v AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS i FROM c WHERE {_READ} AND id IS NOT NULL), x AS (SELECT page, pos AS extra, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS i FROM c WHERE pos % 8 < 3), "
    f"j AS (SELECT v.*, x.extra, coalesce('JSON ' || {_text('x.extra')}, header, 'LUN ' || {_text('id')}) AS title FROM v LEFT JOIN x USING (page, i)) "
    f"SELECT page, i, {_text('id')} AS source_id, title, CASE WHEN extra IS NOT NULL THEN 'вул. ' || {_text('extra')} || ', Львів, ' ELSE '' END || title AS place, CASE WHEN extra IS NOT NULL THEN 'Львів' END AS city, CASE WHEN lng IS NOT NULL THEN 49.8 END AS latitude, lng AS longitude, "
    "CASE section WHEN 2 THEN 'apartment' WHEN 4 THEN 'house' ELSE 'unknown' END AS property_type, price AS amount, upper(coalesce(currency, 'UAH')) AS currency, CAST(rooms AS DOUBLE) AS rooms, CAST(day || ' 09:00:00' AS TIMESTAMP) AS published_at, agency OR coalesce(contact = 'Rieltor', false) AS agent FROM j"
)
def src15_src16_jn10_cards_by_position(spark, sf):
    """The n-th valid card of a page with the n-th JSON-LD item, as listings."""
    read = lun_cards(spark, sf)
    cards = read.select("page", F.posexplode("cards").alias("i", "card"))
    extras = read.select("page", F.posexplode("extras").alias("i", "extra"))
    found = cards.join(extras, ["page", "i"], "left").select("page", "i", sites.card_listing(F.col("card"), F.col("extra")).alias("l"))
    names = ["source_id", "title", "place", "city", "latitude", "longitude", "property_type", "amount", "currency", "rooms", "agent"]
    return found.select("page", "i", *(f"l.{c}" for c in names), F.col("l.published_at").cast("timestamp_ntz").alias("published_at"))


# --- cards in HTML ---------------------------------------------------------------------------------------------------

_BOXES = """
SELECT o_orderkey AS pos, CAST(floor(o_orderkey / 6) AS BIGINT) AS page, CAST(floor(o_orderkey / 6) AS BIGINT) % 9 AS kind, 'вул. Зелена ' || CAST(o_orderkey AS STRING) AS address, CASE WHEN o_orderkey % 4 <> 0 THEN 'Львів, Сихівський' ELSE 'Львів' END AS region,
  CASE o_orderkey % 5 WHEN 0 THEN 'Власник' WHEN 1 THEN 'Рієлтор' WHEN 2 THEN 'Помічник' END AS role, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 = 0 END AS enriched, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 8 <> 5 AS linked
FROM {orders}
"""


def rieltor_pages(spark, sf):
    """(page, url, html): cards, JSON-LD by URL, a declared count, recommended cards after the list; some pages of another place. Rows are grouped as they are; the page's text is made from its group."""
    item_url = lambda r: F.concat(F.lit("https://rieltor.ua/flats/view/"), r["pos"].cast("string"), F.lit("/"))
    box = lambda r: F.concat(
        F.lit(sites.ITEM_CARD + ' data-catalog-item-id="'), r["pos"].cast("string"), F.lit('" data-latitude="49,8" data-longitude="24.0">'), F.when(r["linked"], F.concat(F.lit('<a href="'), item_url(r), F.lit('">'))).otherwise("<a>"),
        F.lit('</a><div class="catalog-card-address"><b>'), r["address"], F.lit('</b></div><div class="catalog-card-region"><span>'), r["region"], F.lit('</span></div><strong class="catalog-card-price-title">'), r["price"].cast("string"),
        F.lit(" грн</strong>"), F.when(r["role"].isNotNull(), F.concat(F.lit('<div class="catalog-card-author-subtitle"><span> '), r["role"], F.lit(" </span></div>"))).otherwise(""), F.lit("</div>"),
    )
    item = lambda r: F.to_json(F.struct(F.struct(F.regexp_replace(item_url(r), "/$", "").alias("url"), F.concat(F.lit("опис "), r["pos"].cast("string")).alias("description")).alias("item")))
    # by number: a page takes many times the work of its rows, and partitions joined up by their bytes are few more than the cores, so a second round runs on some of them
    rows = bound(spark, sf, _BOXES).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page", "kind")
    listed = rows.groupBy("page", "kind").agg(F.sort_array(F.collect_list(F.struct("pos", "address", "region", "role", "enriched", "price", "linked"))).alias("x"))
    listed = listed.select("page", "kind", F.array_join(F.transform("x", box), "").alias("boxes"), F.array_join(F.transform(F.filter("x", lambda r: r["enriched"]), item), ",").alias("items"))
    kind, boxes, items = F.col("kind"), F.col("boxes"), F.col("items")
    count = F.when(kind == 1, "немає оголошень").otherwise("1 200 оголошень")
    body = F.when(kind == 2, "").when(kind == 1, "<div data-listing-items></div>").otherwise(F.concat(F.lit("<div data-listing-items>"), boxes, F.lit("<div data-listing-add-items>"), boxes, F.lit("</div></div>")))
    html = F.concat(
        F.lit("<title>Оренда, "), F.when(kind == 0, "Київ").otherwise("Львів"), F.lit("</title><span data-listing-count>"), count, F.lit("</span>"), body, F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), items, F.lit("]}</script>")
    )
    return listed.select("page", F.lit("https://rieltor.ua/lviv/flats-rent/").alias("url"), html.alias("html"))


def rieltor_cards(spark, sf):
    read = rieltor_pages(spark, sf).select("page", "html", sites.resolved_place(F.col("html"), F.col("url")).alias("resolved"), sites.declared_count(F.col("html")).alias("declared"), sites.main_cards(F.col("html")).alias("cards"))
    return read.withColumn("cards", F.when(F.col("resolved"), F.col("cards")))  # a page of another place is worth nothing


@query(
    f"WITH b AS ({plain(_BOXES)}), p AS (SELECT page, kind, count(*) AS n, count(*) FILTER (WHERE linked) AS ok FROM b GROUP BY page, kind) "
    "SELECT page, kind <> 0 AS resolved, CASE WHEN kind = 1 THEN 0 ELSE 1200 END AS declared, CASE WHEN kind IN (0, 1, 2) THEN 0 ELSE n END AS n_cards, CASE WHEN kind IN (0, 1, 2) THEN 0 ELSE ok END AS n_listings, "
    "CASE WHEN kind IN (0, 2) THEN 'parser_failure' WHEN kind = 1 THEN 'valid_empty' WHEN ok = 0 THEN 'parser_failure' ELSE 'ok' END AS result_kind, kind NOT IN (0, 1, 2) AND ok < 1200 AS truncated FROM p"
)
def src18_src20_src21_str23_card_pages(spark, sf):
    """Pages of HTML cards: whether they are about the place asked for, how many listings they declare and hold, and the kind of result."""
    ok = F.coalesce(F.size(F.filter(F.transform("cards", lambda c: sites.html_card(c, sites.IDENTIFIED)), sites.identified)), F.lit(0))
    read = rieltor_cards(spark, sf).withColumn("n_cards", F.coalesce(F.size("cards"), F.lit(0))).withColumn("n_listings", ok)
    kind = F.when(F.col("cards").isNull(), "parser_failure").when(F.col("n_listings") > 0, "ok").when(F.col("declared") == 0, "valid_empty").otherwise("parser_failure")
    return read.select("page", "resolved", "declared", "n_cards", "n_listings", kind.alias("result_kind"), F.expr("cards is not null and declared > n_listings").alias("truncated"))


@query(
    f"WITH b AS ({plain(_BOXES)}) SELECT page, {_text('pos')} AS source_id, 'https://rieltor.ua/flats/view/' || {_text('pos')} AS url, address, 'Львів' AS city, CASE WHEN region LIKE '%,%' THEN 'Сихівський' END AS district, CASE role WHEN 'Власник' THEN 'owner' WHEN 'Рієлтор' THEN 'agent' ELSE 'unknown' END AS seller, "
    f"CAST(price AS DOUBLE) AS amount, 49.8 AS latitude, CASE WHEN enriched THEN 'опис ' || {_text('pos')} END AS description FROM b WHERE linked AND kind NOT IN (0, 1, 2)"
)
def src19_jn11_fn23_cards_by_url(spark, sf):
    """Cards of HTML with the JSON-LD item of the same normalised URL. Both stand on one page, so they meet in its row; what is exploded is made where it is exploded, since a filter on a name would make it again."""
    from brindle.functions.urls import canonical

    read = rieltor_cards(spark, sf).select("page", "cards", F.when(F.col("cards").isNotNull(), sites.linked_items(F.col("html"))).alias("items"))
    listing = lambda c, url: F.struct(
        c["id"].alias("source_id"), url.alias("url"), c["address"].alias("address"), c["place"]["city"].alias("city"), c["place"]["district"].alias("district"), sites.role_of_label(c["role"]).alias("seller"), c["amount"].alias("amount"), c["latitude"].alias("latitude"),
        sites.item_of(F.col("items"), url)["description"].alias("description"),
    )
    wanted = (*sites.IDENTIFIED, "address", "place", "role", "amount", "latitude")
    found = F.filter(F.transform("cards", lambda c: sites.html_card(c, wanted)), sites.identified)
    return read.select("page", F.inline(F.transform(found, lambda c: sellers.bound(canonical(c["url"]), lambda url: listing(c, url)))))


# --- catalogs in a page's state --------------------------------------------------------------------------------------

_ENTRIES = """
SELECT o_orderkey AS pos, CAST(floor(o_orderkey / 7) AS BIGINT) AS page, CAST(floor(o_orderkey / 7) AS BIGINT) % 8 AS kind, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 13 <> 0 THEN 'realty-' || CAST(o_orderkey AS STRING) || '.html' END AS path,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'Наукова' END AS street, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 END AS kind_id, CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderkey % 7 AS STRING) END AS role, CAST(o_totalprice AS STRING) AS price, CASE WHEN o_orderkey % 2 = 0 THEN '$' END AS currency,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 08:30:00' END AS published, o_orderkey % 9 AS agency
FROM {orders}
"""


def domria_states(spark, sf):
    """(page, state): the catalog that a page's state assignment holds; some pages without the array, some cut off."""
    entry = F.struct(
        F.col("id").alias("realty_id"), F.col("path").alias("beautiful_url"), F.lit("Львів").alias("city_name_uk"), F.col("street").alias("street_name_uk"), F.lit("49,8").alias("latitude"), F.lit("24.0").alias("longitude"), "price", F.col("currency").alias("currency_type"),
        F.col("published").alias("publishing_date"), F.col("kind_id").alias("realty_type_id"), F.struct(F.col("role").alias("1437")).alias("characteristics_values"), F.col("agency").alias("agency_id"),
    )
    rows = bound(spark, sf, _ENTRIES).select("page", "kind", "pos", F.to_json(entry).alias("raw"))
    listed = rows.groupBy("page", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), ",").alias("raw"))
    array = F.concat(F.lit('{"realtyForCatalog":'), F.when(F.col("kind") == 1, "[]").otherwise(F.concat(F.lit("["), "raw", F.lit("]"))), F.lit("}"))
    state = F.concat(F.lit('{"catalog":'), F.when(F.col("kind") == 0, "{}").otherwise(array), F.lit("}"))
    html = F.concat(F.lit("<script>window.__INITIAL_STATE__="), F.when(F.col("kind") == 2, F.left(state, F.length(state) - 2)).otherwise(state), F.lit(";</script>"))
    return listed.select("page", F.try_parse_json(pages.state_column(html, "__INITIAL_STATE__", strings=False)).alias("state"))


@query(
    f"WITH e AS ({plain(_ENTRIES)}) SELECT page, kind NOT IN (0, 2) AS present, count(*) FILTER (WHERE kind > 2) AS n_raw, count(*) FILTER (WHERE kind > 2 AND id IS NOT NULL AND path IS NOT NULL) AS n_listings, "
    "CASE WHEN kind IN (0, 2) THEN 'parser_failure' WHEN count(*) FILTER (WHERE kind > 2 AND id IS NOT NULL AND path IS NOT NULL) > 0 THEN 'ok' WHEN kind = 1 THEN 'valid_empty' ELSE 'parser_failure' END AS result_kind FROM e GROUP BY page, kind"
)
def src22_src23_catalog_states(spark, sf):
    """A missing catalog array is a failure, an empty one an empty market, one of which no entry is a listing a failure."""
    read = domria_states(spark, sf).select("page", F.try_variant_get("state", "$.catalog.realtyForCatalog", "array<variant>").alias("items"))
    ok = F.coalesce(F.size(F.filter(F.transform("items", sites.entry_listing), lambda x: x["source_id"].isNotNull())), F.lit(0))
    read = read.select("page", F.col("items").isNotNull().alias("present"), F.coalesce(F.size("items"), F.lit(0)).alias("n_raw"), ok.alias("n_listings"))
    return read.withColumn("result_kind", F.expr("case when not present then 'parser_failure' when n_listings > 0 then 'ok' when n_raw = 0 then 'valid_empty' else 'parser_failure' end"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sites.ROLES.items())


@query(
    f"WITH e AS ({plain(_ENTRIES)}) SELECT page, {_text('id')} AS source_id, 'https://dom.ria.com/uk/' || path AS url, CASE WHEN street IS NULL THEN 'Львів' ELSE street || ', Львів' END AS title, CASE kind_id WHEN 2 THEN 'apartment' WHEN 5 THEN 'house' ELSE 'unknown' END AS property_type, CAST(price AS DOUBLE) AS amount, coalesce(currency, 'UAH') AS currency, "
    f"CAST(published AS TIMESTAMP) AS published_at, CASE role {_LABELS} END AS role, CASE WHEN role = '2' THEN 'owner' WHEN role IN ('1', '3') THEN 'agent' WHEN role IN ('4', '5') THEN 'business' WHEN role IS NOT NULL THEN 'unrecognized' END AS seller, CAST(agency AS DOUBLE) AS agency FROM e WHERE kind > 2 AND id IS NOT NULL AND path IS NOT NULL"
)
def src23_cls10_catalog_entries(spark, sf):
    """Entries of the catalogs as listings, with the seller's role by its code."""
    items = domria_states(spark, sf).select("page", F.explode(F.try_variant_get("state", "$.catalog.realtyForCatalog", "array<variant>")).alias("v"))
    rows = items.select("page", sites.entry_listing(F.col("v")).alias("l")).where("l.source_id is not null")
    return rows.select("page", *(f"l.{c}" for c in ("source_id", "url", "title", "property_type", "amount", "currency", "role", "seller", "agency")), F.col("l.published_at").cast("timestamp_ntz").alias("published_at"))


@query("SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS found, CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '1' END END AS role FROM orders")
def src25_record_with_role(spark, sf):
    """A listing's record inside a page's state; the role stands on the record or on what it lies in."""
    own = F.expr("case o_orderkey % 4 when 0 then '\"characteristics_values\":{\"1437\":\"2\"},' when 1 then '\"1437\":3,' else '' end")
    above = F.expr("case when o_orderkey % 4 = 2 then '\"1437\":\"1\",' else '' end")
    asked = F.expr("if(o_orderkey % 5 = 0, -1, o_orderkey)").cast("string")
    raw = F.concat(F.lit('{"a":[{"realty_id":0}],"page":{'), above, F.lit('"card":{'), own, F.lit('"realty_id":'), F.col("o_orderkey").cast("string"), F.lit("}}}"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), pages.record_with_role(raw, asked, "realty_id", "1437").alias("r")).select("id", "r.found", "r.role")


# --- sellers' pages and search URLs ----------------------------------------------------------------------------------

_DETAILS = """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'owner' WHEN 1 THEN 'agent' WHEN 2 THEN 'business' WHEN 3 THEN 'Intermediary' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS business, o_orderkey % 11 = 0 AS other, o_orderkey % 13 = 0 AS cut,
  o_orderkey % 5 = 0 AS young, CASE WHEN o_orderkey % 17 = 0 THEN 'Best Realty' ELSE 'Марія' END AS name FROM {orders}
"""


@query(
    f"WITH d AS ({plain(_DETAILS)}), c AS (SELECT *, lower(coalesce(kind, '')) IN ('agent', 'intermediary', 'business') OR name = 'Best Realty' AS ex FROM d) SELECT id, CASE WHEN other OR cut THEN 'parser_failure' WHEN ex THEN 'confirmed_intermediary' WHEN young THEN 'seller_registration_year_2026' "
    "WHEN kind = 'owner' THEN 'confirmed_owner' WHEN business THEN 'confirmed_intermediary' ELSE 'unknown' END AS verdict, CASE WHEN young THEN '2026' ELSE '2019' END AS year FROM c"
)
def src26_cls21_detail_seller(spark, sf):
    """Detail pages: the offer must be the one asked for; intermediaries, then the year of registration, then the account, then owners."""
    ad = F.struct(F.concat(F.lit("https://www.olx.ua/d/x-ID"), F.when(F.col("other"), "zz").otherwise(F.col("id").cast("string")), F.lit(".html")).alias("url"), F.lit("Квартира").alias("title"), "business", F.struct(F.col("kind").alias("sellerType"), "name").alias("user"))
    state = F.to_json(F.struct(F.struct(ad.alias("ad")).alias("ad")))
    html = F.concat(F.lit("<script>window.__STATE__ = "), F.when(F.col("cut"), F.left(state, F.lit(30))).otherwise(state), F.lit(";</script><p>На OLX з червня "), F.when(F.col("young"), "2026").otherwise("2019"), F.lit(" року</p>"))
    rows = bound(spark, sf, _DETAILS).select("id", html.alias("html"))
    rows = rows.withColumn("s", pages.decoded_state(pages.state_column(F.col("html"), "__STATE__")))
    return rows.select("id", sites.linked_seller(F.col("s"), F.col("html"), F.col("id").cast("string")).alias("verdict"), sites.registration_year(F.col("html")).alias("year"))


_MARKS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Власник' WHEN 1 THEN 'Рієлтор' WHEN 2 THEN 'Консультант' END AS role, CASE WHEN o_orderkey % 7 = 0 THEN 'АН Дім' END AS agency FROM {orders}"


@query(f"WITH m AS ({plain(_MARKS)}) SELECT id, CASE WHEN role IS NULL AND agency IS NULL THEN 'parser_failure' WHEN agency IS NOT NULL OR role = 'Рієлтор' THEN 'confirmed_intermediary' WHEN role = 'Власник' THEN 'confirmed_owner' ELSE 'unknown' END AS verdict FROM m")
def src26_detail_role(spark, sf):
    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<div class="{name}"> '), F.col(c), F.lit(" </div>"))).otherwise("")
    html = F.concat(tag("offer-view-rieltor-position", "role"), F.lit("<p>...</p>"), tag("offer-view-rieltor-agency-link", "agency"))
    return bound(spark, sf, _MARKS).select("id", sites.detail_seller(html).alias("verdict"))


_PROFILES = "SELECT l_orderkey AS seller, l_partkey AS part, l_suppkey AS supp, l_quantity AS q, l_quantity > 10 AS estate, l_quantity > 30 AS precise FROM {lineitem}"


@query(
    f"WITH p AS ({plain(_PROFILES)}) SELECT seller, seller % 6 <> 0 AS acquired, CASE WHEN seller % 6 <> 0 THEN 1 END AS total_pages, CASE WHEN seller % 6 <> 0 THEN count(*) ELSE 0 END AS visible_ads, CASE WHEN seller % 6 <> 0 THEN count(*) FILTER (WHERE estate) ELSE 0 END AS real_estate_ads, "
    "CASE WHEN seller % 6 <> 0 THEN count(DISTINCT CASE WHEN estate AND precise THEN part END) ELSE 0 END AS n_precise, CASE WHEN seller % 6 <> 0 THEN count(DISTINCT CASE WHEN estate AND NOT precise THEN supp END) ELSE 0 END AS n_coarse FROM p GROUP BY seller"
)
def src27_profile_inventory(spark, sf):
    """Profile pages: ads of homes, and different places of each exactness; a page without its totals is not acquired."""
    ad = F.struct(F.struct(F.when(F.col("estate"), "real_estate").otherwise("goods").alias("type")).alias("category"), F.lit("Львів").alias("city"), F.when(F.col("precise"), F.concat(F.lit("вул. "), F.col("part").cast("string"))).alias("street"), F.when(~F.col("precise"), F.concat(F.lit("район "), F.col("supp").cast("string"))).alias("district"))
    listed = bound(spark, sf, _PROFILES).select("seller", F.to_json(ad).alias("ad")).groupBy("seller").agg(F.array_join(F.collect_list("ad"), ",").alias("ads"), F.count("*").alias("n"))
    total = F.when(F.expr("seller % 6 = 0"), '"x"').otherwise(F.col("n").cast("string"))
    raw = F.concat(F.lit('{"userListing":{"userListing":{"totalPages":1,"totalElements":'), total, F.lit(',"ads":['), F.col("ads"), F.lit("]}}}"))
    read = listed.select("seller", F.try_parse_json(raw).alias("state")).select("seller", sites.profile_inventory(F.col("state")).alias("p"))
    fields = lambda a: F.struct(sites.text(a, "$.category.type").alias("type"), *(sites.text(a, f"$.{c}").alias(c) for c in ("city", "district", "street")))
    place = lambda f: F.struct(F.coalesce(f["type"] == "real_estate", F.lit(False)).alias("estate"), sellers.location_key(f["city"], f["district"], f["street"], f["street"].isNotNull()).alias("k"))
    # a page is one row, so its ads are read and counted where they are, once each
    ads = F.when(F.col("p.acquired"), F.transform("p.ads", lambda a: sellers.bound(fields(a), place)))
    read = read.select("seller", "p.acquired", F.when(F.col("p.acquired"), F.col("p.total_pages")).alias("total_pages"), ads.alias("ads"))
    places = lambda kind: F.size(F.array_distinct(F.transform(F.filter("ads", lambda a: a["estate"] & (a["k"]["kind"] == kind)), lambda a: a["k"]["key"])))
    counts = {"visible_ads": F.size("ads"), "real_estate_ads": F.size(F.filter("ads", lambda a: a["estate"])), "n_precise": places("precise"), "n_coarse": places("coarse")}
    return read.select("seller", "acquired", "total_pages", *(F.coalesce(F.when(F.col("ads").isNotNull(), c), F.lit(0)).cast("bigint").alias(name) for name, c in counts.items()))


_LINKS = """SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<a href="/uk/list/user/Ab' || CAST(page_id AS STRING) || '">' WHEN 1 THEN '<a data-testid="seller-link" href="https://m.olx.ua/x"><a data-testid="user-profile-link" href="https://Shop' || CAST(page_id AS STRING) || '.olx.ua/uk/">'
 WHEN 2 THEN '<a href="https://home' || CAST(page_id AS STRING) || '.olx.ua/home/">' WHEN 3 THEN '<a href="https://blog.olx.ua/home/">' ELSE '' END AS html FROM {pages}"""


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/uk/list/user/Ab' || CAST(page_id AS STRING) || '/' WHEN 1 THEN 'https://shop' || CAST(page_id AS STRING) || '.olx.ua/uk/home/' WHEN 2 THEN 'https://home' || CAST(page_id AS STRING) || '.olx.ua/uk/home/' END AS target FROM pages")
def fn21_inventory_target(spark, sf):
    """Where a seller's inventory may be read: the public profile first, else the shop; names that the site keeps are no shops."""
    return bound(spark, sf, _LINKS).select("page_id", F.coalesce(sites.profile_path(F.col("html")), sites.shop_url(F.col("html"))).alias("target"))


_ASKED = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'domria' WHEN 1 THEN 'lun' WHEN 2 THEN 'rieltor' ELSE 'olx' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'house' ELSE 'apartment' END AS kind, CAST(o_orderkey % 5 + 1 AS INT) AS page, o_orderkey % 8 < 4 AS owners FROM {orders}"
_PAGE_OF = lambda sep: f"CASE WHEN page > 1 THEN '{sep}page=' || CAST(page AS STRING) ELSE '' END"


@query(
    f"WITH a AS ({plain(_ASKED)}) SELECT id, CASE source WHEN 'domria' THEN 'https://dom.ria.com/node/searchEngine/v2/?category=' || CASE kind WHEN 'house' THEN '4&realty_type=0' ELSE '1&realty_type=2' END || '&operation=3&sort=created_at&page=0&city_ids=5' "
    f"WHEN 'lun' THEN 'https://lun.ua/rent/lviv/' || CASE kind WHEN 'house' THEN 'houses' ELSE 'flats' END || {_PAGE_OF('?')} WHEN 'rieltor' THEN 'https://rieltor.ua/lviv/' || CASE kind WHEN 'house' THEN 'houses' ELSE 'flats' END || '-rent/?sort=bycreated' || CASE WHEN owners THEN '&f-owners=1' ELSE '' END || {_PAGE_OF('&')} "
    f"ELSE 'https://www.olx.ua/uk/nedvizhimost/' || CASE kind WHEN 'house' THEN 'doma/arenda-domov' ELSE 'kvartiry/dolgosrochnaya-arenda-kvartir' END || '/lvov/?search%5Bdist%5D=15&search%5Bprivate_business%5D=' || CASE WHEN owners THEN 'private' ELSE 'business' END || {_PAGE_OF('&')} END AS url, "
    "CASE source WHEN 'domria' THEN 0 WHEN 'lun' THEN 1 ELSE 2 END AS rank, CASE source WHEN 'olx' THEN 'browser' ELSE 'http' END AS transport FROM a WHERE source <> 'rieltor'"
)
def src30_src31_search_urls(spark, sf):
    """Page addresses of the enabled sources, in their order; the browser replaces plain requests where it is enabled."""
    enabled = sites.enabled_sources({"domria": True, "lun": True, "olx": True, "olx_browser": True})
    registry = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(enabled)], "source string, transport string, rank int")
    rows = bound(spark, sf, _ASKED).join(F.broadcast(registry), "source")  # a row a source
    return rows.select("id", sites.search_url(F.col("source"), F.col("kind"), F.col("page"), F.col("owners")).alias("url"), "rank", "transport")
