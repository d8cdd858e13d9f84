"""Queries over single records: scalar functions, filters, classifiers, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import geo, sellers, texts, urls
from brindle.operators import decisions
from brindle.operators import freshness as fresh
from brindle.operators.state import backoff_ms
from brindle.plans.base import L, NOW, bound, listings, plain, query, table

CENTER, RADIUS_KM = (49.8397, 24.0297), 15.0
_NUM = lambda c: f"TRY_CAST(replace(trim({c}), ',', '.') AS DOUBLE)"
_GEO = f"""
g AS (SELECT *, {_NUM('lat')} AS a, {_NUM('lng')} AS b FROM l),
h AS (SELECT *, coalesce(a > 15 AND a < 43 AND b > 43 AND b < 55, false) AS sw FROM g),
i AS (SELECT *, CASE WHEN sw THEN b ELSE a END AS y, CASE WHEN sw THEN a ELSE b END AS x FROM h),
v AS (SELECT *, CASE WHEN lat IS NULL AND lng IS NULL THEN 'missing' WHEN a IS NULL OR b IS NULL THEN 'malformed' WHEN a = 0 AND b = 0 THEN 'zero'
  WHEN NOT (y BETWEEN 44 AND 53 AND x BETWEEN 22 AND 41) THEN 'out-of-range' ELSE 'ok' END AS reason FROM i),
d AS (SELECT *, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y - 49.8397) / 2), 2) + cos(radians(49.8397)) * cos(radians(y)) * pow(sin(radians(x - 24.0297) / 2), 2)))) AS km FROM v)
"""


@query(L + "," + _GEO + "SELECT pos, round(km, 6) AS km FROM d WHERE reason = 'ok'")
def fn1_haversine(spark, sf):
    p = geo.validated(F.col("lat"), F.col("lng"))
    return listings(spark, sf).withColumn("p", p).where("p.reason = 'ok'").select("pos", F.round(geo.haversine_km(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("p.latitude"), F.col("p.longitude")), 6).alias("km"))


@query(L + "," + _GEO + "SELECT pos, reason, CASE WHEN reason = 'ok' THEN y END AS latitude, CASE WHEN reason = 'ok' THEN x END AS longitude, reason = 'ok' AND sw AS swapped FROM v")
def fn2_coordinates(spark, sf):
    return listings(spark, sf).withColumn("p", geo.validated(F.col("lat"), F.col("lng"))).select("pos", "p.reason", "p.latitude", "p.longitude", "p.swapped")


_PARSED = r"""
u AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2) AS authority,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) AS path FROM l),
w AS (SELECT *, regexp_replace(regexp_replace(lower(authority), ':\d+$', ''), '^www\.', '') AS host FROM u),
c AS (SELECT *, CASE WHEN scheme = '' THEN lower(trim(url)) ELSE lower(scheme) || '://' || host || lower(regexp_replace(path, '/+$', '')) END AS canonical,
  CASE WHEN host = 'olx.ua' OR host LIKE '%.olx.ua' THEN 'olx' WHEN host = 'rieltor.ua' OR host LIKE '%.rieltor.ua' THEN 'rieltor' WHEN host = 'dom.ria.com' OR host LIKE '%.dom.ria.com' THEN 'domria' END AS platform FROM w),
e AS (SELECT *, CASE platform WHEN 'olx' THEN nullif(regexp_extract(url, '(?i)ID([A-Za-z0-9]+)\.html', 1), '') WHEN 'rieltor' THEN nullif(regexp_extract(url, '(?i)/view/(\d+)(?:/|$)', 1), '')
  WHEN 'domria' THEN nullif(regexp_extract(url, '(?i)(\d{6,})\.html$', 1), '') END AS external FROM c)
"""
U = L + "," + _PARSED


@query(U + "SELECT pos, canonical FROM c")
def fn3_canonical_url(spark, sf):
    return listings(spark, sf).select("pos", urls.canonical(F.col("url")).alias("canonical"))


@query(U + "SELECT pos, source || ':' || source_id || ':' || canonical AS fingerprint FROM c")
def fn4_fingerprint(spark, sf):
    return listings(spark, sf).select("pos", urls.fingerprint(F.col("source"), F.col("source_id"), F.col("url")).alias("fingerprint"))


@query(U + "SELECT pos, platform, external FROM e")
def fn5_fn6_platform_and_external_id(spark, sf):
    of = urls.platform(urls.host(F.col("url")))
    return listings(spark, sf).select("pos", of.alias("platform"), urls.external_id(of, F.col("url")).alias("external"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), ':\\d+$', ''), '^www\\.', '') AS host, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', ''), '://www\\.', '://') AS canonical FROM pages")
def fn29_page_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("canonical"))


def provenance(df):
    """Where a listing says it comes from: its own canonical URL, and another platform's URL and id if it names one."""
    of = urls.platform(urls.host(F.col("url")))
    other = of.isNotNull() & (of != F.col("source"))
    return df.withColumn("canonical", urls.canonical(F.col("url"))).withColumn("external_name", F.when(other, of)).withColumn("external_url", F.when(other, F.col("canonical"))).withColumn(
        "external_id", F.when(other, urls.external_id(of, F.col("url")))
    )


@query(U + "SELECT pos, canonical, CASE WHEN platform <> source THEN platform END AS external_name, CASE WHEN platform <> source THEN canonical END AS external_url, CASE WHEN platform <> source THEN external END AS external_id FROM e")
def fn7_provenance(spark, sf):
    return provenance(listings(spark, sf)).select("pos", "canonical", "external_name", "external_url", "external_id")


def identity_keys(df):
    """(pos, source, source_id, key, key_class): every key by which a listing may be known, each of its strongest class."""
    from brindle.operators.matching import CLASSES

    key = lambda k, c: F.struct(k.alias("key"), F.lit(c).alias("key_class"))
    token = F.nullif(F.regexp_extract("url", urls.ID_PATTERNS["olx"], 1), F.lit(""))
    prefix = F.when(F.col("external_name") == "olx", "olx:token:").when(F.col("external_name") == "rieltor", "rieltor:id:").otherwise("domria:id:")
    own = F.when(F.col("source") == "olx", F.concat(F.lit("olx:token:"), token)).when(F.col("source").isin("rieltor", "domria"), F.concat(F.col("source"), F.lit(":id:"), F.col("source_id")))
    group = F.when(F.col("source") == "lun", F.concat(F.lit("lun:group:"), (F.col("pos") / 8).cast("int").cast("string")))
    keys = F.array(
        key(F.concat(F.lit("url:"), F.col("canonical")), "own"),
        key(own, "own"),
        key(group, "lun_cluster"),
        key(F.concat(F.lit("url:"), F.col("external_url")), "explicit_external"),
        key(F.concat(prefix, F.col("external_id")), "explicit_external"),
    )
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("k.key_class"))
    rows = provenance(df).select("pos", "source", "source_id", F.explode(keys).alias("k")).where("k.key is not null")
    return rows.groupBy("pos", "source", "source_id", F.col("k.key").alias("key")).agg(F.element_at(F.array(*map(F.lit, CLASSES)), F.max(rank).cast("int")).alias("key_class"))  # numbers are hashed, strings would be sorted


KEYS = (
    U
    + """, x AS (SELECT *, CASE WHEN platform <> source THEN platform END AS en, CASE WHEN platform <> source THEN canonical END AS eu, CASE WHEN platform <> source THEN external END AS ei FROM e),
k0 AS (SELECT pos, source, source_id, 'url:' || canonical AS key, 2 AS r FROM x
  UNION ALL SELECT pos, source, source_id, CASE WHEN source = 'olx' THEN 'olx:token:' || nullif(regexp_extract(url, '(?i)ID([A-Za-z0-9]+)\\.html', 1), '') WHEN source <> 'lun' THEN source || ':id:' || source_id END, 2 FROM x
  UNION ALL SELECT pos, source, source_id, 'lun:group:' || CAST(CAST(floor(pos / 8) AS INT) AS STRING), 1 FROM x WHERE source = 'lun'
  UNION ALL SELECT pos, source, source_id, 'url:' || eu, 3 FROM x
  UNION ALL SELECT pos, source, source_id, CASE en WHEN 'olx' THEN 'olx:token:' WHEN 'rieltor' THEN 'rieltor:id:' ELSE 'domria:id:' END || ei, 3 FROM x WHERE en IS NOT NULL),
k AS (SELECT pos, source, source_id, key, CASE max(r) WHEN 3 THEN 'explicit_external' WHEN 2 THEN 'own' ELSE 'lun_cluster' END AS key_class FROM k0 WHERE key IS NOT NULL GROUP BY ALL) """
)


@query(KEYS.replace("GROUP BY ALL", "GROUP BY pos, source, source_id, key") + "SELECT * FROM k")
def fn8_identity_keys(spark, sf):
    return identity_keys(listings(spark, sf))


@query(U + r"SELECT pos, CASE WHEN lower(scheme) = 'https' AND host IN ('dom.ria.com', 'rieltor.ua') AND regexp_matches(path, '/view/\d+|realty-\d+\.html') THEN canonical END AS target FROM c")
def fn9_detail_target(spark, sf):
    return listings(spark, sf).select("pos", urls.detail_target(F.col("url"), ["dom.ria.com", "rieltor.ua"], r"/view/\d+|realty-\d+\.html").alias("target"))


_PRICES = """
SELECT o_orderkey AS pos, CASE o_orderkey % 6 WHEN 0 THEN '$ ' || CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey AS STRING) || ',50 EUR' WHEN 2 THEN '1 ' || CAST(o_orderkey AS STRING) || ' грн.'
  WHEN 3 THEN CAST(o_orderkey AS STRING) || ' PLN' WHEN 4 THEN '-- usd' ELSE '12,34,56 $' END AS shown FROM {orders}
"""


@query(
    f"WITH p AS ({plain(_PRICES)}), "
    r"""q AS (SELECT *, CASE WHEN shown LIKE '%$%' OR regexp_matches(shown, '(?i)\busd\b') THEN 'USD' WHEN regexp_matches(shown, '(?i)\beur\b') THEN 'EUR' WHEN shown LIKE '%грн%' THEN 'UAH' END AS currency,
  TRY_CAST(regexp_replace(regexp_replace(shown, '[^0-9,.]', '', 'g'), '^([^,]*),', '\1.') AS DOUBLE) AS amount FROM p)
SELECT pos, CASE WHEN currency IS NOT NULL AND amount > 0 THEN amount END AS amount, CASE WHEN amount > 0 THEN currency END AS currency FROM q"""
)
def fn10_price_from_text(spark, sf):
    return bound(spark, sf, _PRICES).withColumn("p", texts.price_from_text(F.col("shown"))).select("pos", "p.amount", "p.currency")


@query("SELECT event_id, TRY_CAST(replace(regexp_extract(props, ':\\s*([^}]*)', 1), ',', '.') AS DOUBLE) AS number FROM events")
def fn11_tolerant_number(spark, sf):
    return table(spark, sf, "events").select("event_id", geo.number(F.regexp_extract("props", r":\s*([^}]*)", 1)).alias("number"))


_NAIVE = "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 0' || CAST(o_orderkey % 10 AS STRING) || ':30:00' END AS raw FROM {orders}"


@query(f"WITH n AS ({plain(_NAIVE)}) SELECT pos, TRY_CAST(raw AS TIMESTAMP) AS at, TRY_CAST(raw AS TIMESTAMP) IS NOT NULL AS uncertain FROM n")
def fn12_naive_timestamp(spark, sf):
    at = F.try_to_timestamp("raw", F.lit("yyyy-MM-dd HH:mm:ss"))
    return bound(spark, sf, _NAIVE).select("pos", at.cast("timestamp_ntz").alias("at"), at.isNotNull().alias("uncertain"))


_ERRORS = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN 'GET https://api.telegram.org/bot123456:ABCDEFGHIJKL/sendMessage  failed  ' || CAST(page_id AS STRING)
  WHEN 2 THEN 'Bearer abc.def' || CAST(page_id AS STRING) || ' rejected; api_key=xyz&n=1' WHEN 3 THEN '   ' ELSE 'TELEGRAM_BOT_TOKEN=s3cret bot1234567:ABCDEFGHIJ_klm end' END AS message FROM {pages}
"""


@query(
    f"WITH p AS ({plain(_ERRORS)}), "
    r"""q AS (SELECT page_id, trim(regexp_replace(message, '\s+', ' ', 'g')) AS m FROM p)
SELECT page_id, CASE WHEN m = '' THEN NULL WHEN regexp_matches(m, '(?i)<(?:!doctype|html|head|body)\b') THEN 'http_error' ELSE left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m,
  '(?i)api\.telegram\.org/bot[^\s/]+', 'api.telegram.org/bot[redacted]', 'g'), '\bbot\d{5,}:[A-Za-z0-9_-]{10,}\b', '[redacted-bot-token]', 'g'), '(?i)TELEGRAM_BOT_TOKEN=\S+', 'TELEGRAM_BOT_TOKEN=[redacted]', 'g'),
  '(?i)Bearer\s+\S+', 'Bearer [redacted]', 'g'), '(?i)api_key=[^&\s]+', 'api_key=redacted', 'g'), 400) END AS safe FROM q"""
)
def fn13_fn14_safe_error(spark, sf):
    return bound(spark, sf, _ERRORS).select("page_id", texts.safe_error(F.col("message"), F.lit("http_error")).alias("safe"))


@query(r"SELECT page_id, length(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n_escaped, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def fn15_escape_and_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(texts.html_escaped(F.col("html"))).cast("bigint").alias("n_escaped"), F.md5(texts.tags_stripped(F.col("html"))).alias("text_md5"))


_MONEY = r"""
m AS (SELECT *, abs(round(amount, 2)) AS s, upper(trim(currency)) AS t FROM l),
f AS (SELECT *, replace(format('{:,}', CAST(floor(s) AS BIGINT)), ',', ' ') || coalesce(',' || nullif(regexp_replace(lpad(CAST(CAST(round((s - floor(s)) * 100) AS INT) AS STRING), 2, '0'), '0+$', ''), ''), '') AS body,
  CASE t WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'UAH' THEN 'грн' ELSE trim(currency) END AS shown, CASE WHEN period = 'day' THEN 'день' ELSE 'місяць' END AS per FROM m)
"""
_LABEL = "CASE WHEN amount IS NULL THEN 'Ціна не вказана' ELSE CASE WHEN shown IS NULL THEN body WHEN shown IN ('$', '€') THEN shown || body ELSE body || ' ' || shown END || ' / ' || per END"


@query(L + "," + _MONEY + f"SELECT pos, {_LABEL} AS label FROM f")
def fn16_money_label(spark, sf):
    return listings(spark, sf).select("pos", texts.price_label(F.col("amount"), F.col("currency"), F.col("period")).alias("label"))


#: Months as they are shown.
MONTHS = ["січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня"]
_INDEX = lambda c: f"year({c}) * 372 + month({c}) * 31 + day({c})"
_STAMPS = "SELECT event_id, ts + INTERVAL 2 HOURS AS stamp, CAST('2024-01-16 09:00:00' AS TIMESTAMP) AS now FROM {events}"


@query(
    f"WITH s AS ({plain(_STAMPS)}) SELECT event_id, CASE WHEN {_INDEX('stamp')} = {_INDEX('now')} THEN 'сьогодні' WHEN {_INDEX('stamp')} = {_INDEX('now')} - 1 THEN 'вчора' "
    f"ELSE CAST(day(stamp) AS STRING) || ' ' || ({MONTHS!r})[month(stamp)] END || ', ' || strftime(stamp, '%H:%M') AS label FROM s"
)
def fn17_date_label(spark, sf):
    """Dates in a zone two hours east of UTC; days are compared by an index, which misjudges yesterday at ends of months."""
    rows = bound(spark, sf, _STAMPS)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("stamp"))
    day = F.when(F.expr(f"{_INDEX('stamp')} = {_INDEX('now')}"), "сьогодні").when(F.expr(f"{_INDEX('stamp')} = {_INDEX('now')} - 1"), "вчора").otherwise(F.concat_ws(" ", F.dayofmonth("stamp").cast("string"), month))
    return rows.select("event_id", F.concat_ws(", ", day, F.date_format("stamp", "HH:mm")).alias("label"))


def headline(kind, rooms):
    n = F.round(rooms).cast("int")
    counted = lambda noun, alone: F.when(n > 0, F.concat(n.cast("string"), F.lit(f"-кімнатн{noun}"))).otherwise(alone)
    return F.when(kind == "house", counted("ий будинок", "Будинок")).when(kind == "apartment", counted("а квартира", "Квартира")).otherwise("Оголошення")


def facts(area, rooms):
    n = F.round(rooms).cast("int")
    noun = F.when(n == 1, "кімната").when(n < 5, "кімнати").otherwise("кімнат")
    return F.concat_ws(" · ", F.concat(texts.grouped_amount(area), F.lit(" м²")), F.concat_ws(" ", n.cast("string"), noun))


_HEAD = "CASE property_type WHEN 'house' THEN CASE WHEN rooms > 0 THEN CAST(CAST(rooms AS INT) AS STRING) || '-кімнатний будинок' ELSE 'Будинок' END WHEN 'apartment' THEN CASE WHEN rooms > 0 THEN CAST(CAST(rooms AS INT) AS STRING) || '-кімнатна квартира' ELSE 'Квартира' END ELSE 'Оголошення' END"
_FACTS = "CAST(CAST(area AS INT) AS STRING) || ' м² · ' || CAST(CAST(rooms AS INT) AS STRING) || CASE WHEN rooms = 1 THEN ' кімната' WHEN rooms < 5 THEN ' кімнати' ELSE ' кімнат' END"


@query(L + f"SELECT pos, {_HEAD} AS headline, {_FACTS} AS facts FROM l")
def fn18_headline(spark, sf):
    return listings(spark, sf).select("pos", headline(F.col("property_type"), F.col("rooms")).alias("headline"), facts(F.col("area"), F.col("rooms")).alias("facts"))


@query(r"SELECT page_id, sha256(html) AS body_sha256, left(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 120) AS title, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([a-zA-Z]+)', 1))), ',') AS names FROM pages")
def fn20_body_fingerprint(spark, sf):
    names = F.array_join(F.array_sort(F.array_distinct(F.expr(r"""regexp_extract_all(html, r'href="/([a-zA-Z]+)', 1)"""))), ",")
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("body_sha256"), F.left(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit(120)).alias("title"), names.alias("names"))


@query(U + "SELECT pos, CASE WHEN source = 'olx' AND seller_id IS NOT NULL THEN 'olx-user:' || CAST(seller_id AS STRING) WHEN source = 'domria' AND agency THEN 'agency:' || source_id WHEN seller_id IS NOT NULL THEN CAST(seller_id AS STRING) END AS seller FROM c")
def fn25_seller_id(spark, sf):
    seller = F.col("seller_id").cast("string")
    return listings(spark, sf).select(
        "pos", F.when((F.col("source") == "olx") & seller.isNotNull(), F.concat(F.lit("olx-user:"), seller)).when((F.col("source") == "domria") & F.col("agency"), F.concat(F.lit("agency:"), F.col("source_id"))).otherwise(seller).alias("seller")
    )


@query(L + "," + _GEO + f", z AS (SELECT *, CASE WHEN reason = 'missing' THEN 'no-coordinates' WHEN reason <> 'ok' THEN 'invalid-coordinates' WHEN km <= {RADIUS_KM} THEN 'within-radius' ELSE 'outside-radius' END AS why FROM d) SELECT pos, why = 'within-radius' AS matched, why AS reason, CASE WHEN reason = 'ok' THEN round(km, 6) END AS km FROM z")
def flt2_radius(spark, sf):
    rows = listings(spark, sf).withColumn("p", geo.validated(F.col("lat"), F.col("lng"))).withColumn("m", geo.location_match(F.col("p"), CENTER, RADIUS_KM))
    return rows.select("pos", "m.matched", "m.reason", F.round("m.distance_km", 6).alias("km"))


def assessed(df):
    c = sellers.classified(*(F.col(x) for x in ("platform_owner", "platform_agent", "platform_business", "agency", "is_business", "declared", "bare", "text_level")))
    return df.withColumn("c", c).withColumn("seller_type", F.col("c.seller_type")).withColumn("level", F.col("c.level")).drop("c")


_CLS = """
cl0 AS (SELECT *, platform_agent OR platform_business OR agency OR text_level = 'confirmed' AS ex, declared OR (is_business AND bare) AS claim FROM {src}),
cl AS (SELECT *, CASE WHEN platform_owner AND ex THEN 'conflict' WHEN platform_owner THEN 'platform_confirmed' WHEN ex AND claim THEN 'conflict' WHEN ex THEN 'intermediary' WHEN claim AND text_level <> 'likely' THEN 'self_declared'
  WHEN is_business THEN 'business_ambiguous' ELSE 'private_unknown' END AS level, CASE WHEN platform_owner AND NOT ex THEN 'owner' WHEN platform_owner THEN 'unknown' WHEN platform_agent THEN 'agent' WHEN platform_business THEN 'business' ELSE 'unknown' END AS seller_type FROM cl0),
rj AS (SELECT *, CASE WHEN level IN ('conflict', 'intermediary') THEN level WHEN seller_type IN ('agent', 'business') THEN seller_type WHEN level = 'business_ambiguous' THEN level END AS why_not FROM cl)
"""
C = L + "," + _CLS.replace("{src}", "l")
BUCKET = "CASE WHEN why_not IS NOT NULL THEN 'rejected' WHEN level = 'platform_confirmed' THEN 'confirmed_owner' WHEN level = 'self_declared' THEN 'self_declared' ELSE 'unknown' END"


@query(C + "SELECT pos, seller_type, level FROM rj")
def cls1_owner_classifier(spark, sf):
    return assessed(listings(spark, sf)).select("pos", "seller_type", "level")


@query(C + "SELECT pos, CASE WHEN seller_type = 'owner' AND level = 'platform_confirmed' THEN 'confirmed_owner' WHEN seller_type IN ('agent', 'business') OR level IN ('conflict', 'intermediary') THEN 'confirmed_agent' WHEN level = 'self_declared' THEN 'likely_owner' ELSE 'unknown' END AS state, why_not IS NULL AS send FROM rj")
def cls2_assessment(spark, sf):
    return assessed(listings(spark, sf)).select("pos", sellers.assessment(F.col("seller_type"), F.col("level")).alias("a")).select("pos", "a.state", "a.send")


@query(C + f"SELECT pos, why_not IS NULL AS eligible, why_not, {BUCKET} AS bucket FROM rj")
def flt5_flt6_agg3_rejection(spark, sf):
    t, v = F.col("seller_type"), F.col("level")
    return assessed(listings(spark, sf)).select("pos", sellers.rejection_reason(t, v).isNull().alias("eligible"), sellers.rejection_reason(t, v).alias("why_not"), sellers.decision_bucket(t, v).alias("bucket"))


def flagged(spark, sf):
    """Every row with a flag for each predicate, and `accepted` if all hold; null-safe throughout."""
    rows = assessed(listings(spark, sf)).withColumn("p", geo.validated(F.col("lat"), F.col("lng")))
    near = geo.location_match(F.col("p"), CENTER, 60.0)["matched"]
    home = ~F.col("period").eqNullSafe("day") & F.col("property_type").isin("apartment", "house")
    eligible = sellers.rejection_reason(F.col("seller_type"), F.col("level")).isNull()
    old = fresh.too_old(F.col("published_at"), F.expr(f"cast({NOW} as timestamp_ntz)"), F.expr("interval 1000 days"))
    flags = rows.select("pos", "source", near.alias("location_ok"), home.alias("property_ok"), eligible.alias("seller_ok"), old.alias("too_old"), "seller_type", "level")
    return flags.withColumn("accepted", F.expr("location_ok and property_ok and seller_ok and not too_old"))


_FLAGS = (
    L + "," + _GEO + "," + _CLS.replace("{src}", "d")
    + f", fl AS (SELECT *, reason = 'ok' AND km <= 60 AS location_ok, period IS DISTINCT FROM 'day' AND property_type IN ('apartment', 'house') AS property_ok, why_not IS NULL AS seller_ok, coalesce({NOW} - published_at > INTERVAL 1000 DAYS, false) AS too_old FROM rj) "
)


@query(_FLAGS + "SELECT pos, source, location_ok, property_ok, seller_ok, too_old, location_ok AND property_ok AND seller_ok AND NOT too_old AS accepted FROM fl")
def flt1_flt3_flt4_composite_filter(spark, sf):
    return flagged(spark, sf).drop("seller_type", "level")


@query(_FLAGS + "SELECT coalesce(source, 'total') AS source, count(*) AS n, count(*) FILTER (WHERE location_ok AND property_ok AND seller_ok AND NOT too_old) AS accepted, count(*) FILTER (WHERE NOT seller_ok) AS rejected_seller, count(*) FILTER (WHERE level = 'platform_confirmed') AS confirmed FROM fl GROUP BY ROLLUP (source)")
def agg1_agg2_seller_decisions(spark, sf):
    """Counters for each source and in total, computed from the final state, so that nothing has to be retracted."""
    rows = flagged(spark, sf).rollup("source").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(F.expr("not seller_ok")).alias("rejected_seller"), F.count_if(F.expr("level = 'platform_confirmed'")).alias("confirmed"))
    return rows.withColumn("source", F.coalesce("source", F.lit("total")))


@query(C + "SELECT pos, CASE WHEN why_not = 'business_ambiguous' THEN 'recheck' WHEN why_not IS NOT NULL THEN 'terminal' ELSE 'accepted' END AS path FROM rj")
def flt8_cls19_terminal_or_recheck(spark, sf):
    why = sellers.rejection_reason(F.col("seller_type"), F.col("level"))
    return assessed(listings(spark, sf)).select("pos", F.when(why == "business_ambiguous", "recheck").when(why.isNotNull(), "terminal").otherwise("accepted").alias("path"))


#: Parts of texts: own examples, each with what it is by itself: a strong sign of an intermediary (S), one of a supporting family, or none (-).
OPENINGS = [
    ("Я рієлтор, допоможу вам", "S"), ("Я не рієлтор, здаю своє", "-"), ("Без комісії та без рієлторів", "-"), ("Агентство нерухомості Дім", "S"),
    ("Є інші варіанти поруч", "inventory"), ("Маю інші варіанти", "inventory"), ("Ексклюзив, вид на парк", "transaction"), ("Супровід угоди", "service"),
    ("Рієлторам не телефонувати", "-"), ("Здам квартиру від власника", "-"), ("Послуги рієлтора оплачує орендар", "S"), ("Не агентство нерухомості", "-"),
    ("Real estate agents welcome", "S"), ("АН Львів пропонує", "S"), ("не співпрацюю з АН", "-"), ("Працюємо з колегами", "collaboration"), ("", "-"),
    ("Квартира біля парку", "-"), ("Агентам не турбувати", "-"), ("Я риелтор", "S"), ("Ключі на руках", "transaction"), ("Консультація з нерухомості", "service"), ("Дзвоніть після шостої", "-"),
]
CLOSINGS = [
    ("Комісія 50%", "transaction"), ("Покази щодня", "transaction"), ("Допоможу підібрати", "inventory"), ("Сопровождение сделки", "service"), ("Можна з тваринами", "-"),
    ("Від агентства нерухомості", "S"), ("Без рієлторської комісії", "-"), ("Мій колега покаже", "collaboration"), ("Ми рієлтори", "S"), ("Менеджер агентства Ольга", "S"), ("Ціна остаточна", "-"),
]
_pick = lambda number, parts, i: f"CASE {number} " + " ".join(f"WHEN {k} THEN '{p[i]}'" for k, p in enumerate(parts)) + " END"
_A, _B = f"o_orderkey % {len(OPENINGS)}", f"(o_orderkey // {len(OPENINGS)}) % {len(CLOSINGS)}"
_B_SPARK = _B.replace("//", "div")
_CASES = lambda i, b: f"{_pick(_A, OPENINGS, i)} AS one, {_pick(b, CLOSINGS, i)} AS two"


@query(f"WITH s AS (SELECT o_orderkey AS pos, {_CASES(1, _B)} FROM orders) SELECT pos, CASE WHEN 'S' IN (one, two) THEN 'confirmed' WHEN one <> two AND one <> '-' AND two <> '-' THEN 'likely' ELSE 'unknown' END AS level, CASE WHEN 'S' NOT IN (one, two) THEN len(list_distinct(list_filter([one, two], lambda x: x <> '-'))) ELSE 0 END AS n_families FROM s")
def cls3_text_level(spark, sf):
    """Texts of two parts each, 253 different ones; the oracle knows the parts, not the patterns."""
    rows = bound(spark, sf, f"SELECT pos, one || '. ' || two || '.' AS text FROM (SELECT o_orderkey AS pos, {_CASES(0, _B_SPARK)} FROM {{orders}})")
    found = rows.select("pos", sellers.text_signals(F.col("text")).alias("s"))
    return found.select("pos", "s.level", F.size("s.families").cast("bigint").alias("n_families"))


NAME_PARTS = [("Best", "-"), ("Марія", "-"), ("Дім", "-"), ("Олег", "-"), ("ран", "-"), ("Lviv", "-"), ("Галицький", "-"), ("estates", "-"), ("банан", "-"), ("", "-"), ("Karpaty 24", "-")]
NAME_ENDS = [
    ("Realty", "S"), ("Рієлтор", "S"), ("АН", "S"), ("Real Estate", "S"), ("Agency", "S"), ("Агентство нерухомості", "S"), ("агенція", "S"), ("Broker", "S"),
    ("Петренко", "-"), ("канал", "-"), ("2024", "-"), ("Home", "-"), ("агентський", "-"),
]
_N1, _N2 = f"c_custkey % {len(NAME_PARTS)}", f"c_custkey % {len(NAME_ENDS)}"


@query(f"SELECT c_custkey AS id, CASE {_pick(_N2, NAME_ENDS, 1)} WHEN 'S' THEN 'confirmed' ELSE 'unknown' END AS level FROM customer")
def cls4_identity_name(spark, sf):
    """Names of two parts, either first."""
    one, two = _pick(_N1, NAME_PARTS, 0), _pick(_N2, NAME_ENDS, 0)
    rows = bound(spark, sf, f"SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN {one} || ' ' || {two} ELSE {two} || ' ' || {one} END AS name FROM {{customer}}")
    return rows.select("id", sellers.identity_level(F.col("name")).alias("level"))


_PHRASES = " OR ".join(f"lower(text) LIKE '%{p}%'" for p in sellers.SELF_DECLARED)
_SEEKING = " OR ".join(f"lower(text) LIKE '%{p}%'" for p in sellers.OWNER_SEEKING)
_ASKS = "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Здам ВІД ВЛАСНИКА' WHEN 1 THEN 'Шукаю власника, без посередників' WHEN 2 THEN 'Власник здає' WHEN 3 THEN 'власницький' WHEN 4 THEN 'Хозяин, от хозяина' ELSE c_name END AS text FROM {customer}"


@query(f"WITH t AS ({plain(_ASKS)}) SELECT id, ({_PHRASES}) AND NOT ({_SEEKING}) AS declared, ({_SEEKING}) AS seeking, id % 6 IN (2, 3, 4) AS bare FROM t")
def cls5_cls6_owner_phrases(spark, sf):
    t = F.col("text")
    return bound(spark, sf, _ASKS).select("id", sellers.self_declared(t).alias("declared"), sellers.has_phrase(t, sellers.OWNER_SEEKING).alias("seeking"), sellers.bare_owner(t).alias("bare"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(translate(text, '’‘ʼ`–—−', '''''''''---'), '\s+', ' ', 'g'))) AS text_md5 FROM documents")
def cls7_normalized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.normalized(F.col("text"))).alias("text_md5"))


#: Parts of titles: what they ask to be rejected for (the first of short_term, sale, room_unit; excluded only where no home is named), and the home they name.
TITLE_PARTS = [
    ("Здам", "-", "-"), ("Подобово", "short_term", "-"), ("Продаж", "sale", "-"), ("Не для продажу", "-", "-"), ("Кімната", "room_unit", "-"), ("Гараж", "excluded_primary", "-"),
    ("Посуточно", "short_term", "-"), ("For sale", "sale", "-"), ("Офіс у центрі", "excluded_primary", "-"), ("Паркінг", "excluded_primary", "-"), ("Сучасна", "-", "-"), ("Short-term", "short_term", "-"),
]
HOME_PARTS = [("квартира", "-", "apartment"), ("будинок", "-", "house"), ("біля лісу", "-", "-"), ("апартаменти", "-", "apartment"), ("house", "-", "house"), ("склад", "excluded_primary", "-"), ("квартира з гаражем", "-", "apartment"), ("flat", "-", "apartment")]
_T1, _T2 = f"p_partkey % {len(TITLE_PARTS)}", "(p_partkey // 12) % 8"
_TITLES = f"SELECT p_partkey AS id, {_pick(_T1, TITLE_PARTS, 1)} AS r1, {_pick(_T2, HOME_PARTS, 1)} AS r2, {_pick(_T2, HOME_PARTS, 2)} AS home, p_size % 4 AS section FROM part"
_TITLE_REASON = "CASE WHEN r1 IN ('short_term', 'sale', 'room_unit') THEN r1 WHEN home = '-' AND 'excluded_primary' IN (r1, r2) THEN 'excluded_primary' END"


@query(f"WITH t AS ({_TITLES}), r AS (SELECT *, {_TITLE_REASON} AS reason FROM t) SELECT id, reason, CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN section = 2 THEN 'apartment' WHEN home = '-' THEN 'unknown' ELSE home END AS kind FROM r")
def cls8_cls9_property_type(spark, sf):
    """Titles of two parts, some with a section id, which counts more than the words."""
    one, two = _pick(_T1, TITLE_PARTS, 0), _pick(_T2.replace("//", "div"), HOME_PARTS, 0)
    rows = bound(spark, sf, f"SELECT p_partkey AS id, {one} || ' ' || {two} AS title, CAST(CASE WHEN p_size % 4 = 2 THEN 2 END AS INT) AS section FROM {{part}}")
    kind = sellers.property_type(F.lit(None).cast("int"), F.col("section"), F.lit(None).cast("string"), F.col("title"), F.lit(""))
    return rows.select("id", sellers.rental_reject(F.col("title"))["reason"].alias("reason"), kind.alias("kind"))


_PLACES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN ' Lviv. ' END AS city, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS district, CASE WHEN c_custkey % 4 > 1 THEN 'Street, ' || CAST(c_custkey AS STRING) END AS street, c_custkey % 4 = 3 AS building FROM {customer}"
_NORM = lambda c: f"nullif(trim(regexp_replace(translate(lower({c}), '.,', '  '), '\\s+', ' ', 'g')), '')"


@query(
    f"WITH p AS ({plain(_PLACES)}), q AS (SELECT *, {_NORM('city')} AS c, {_NORM('district')} AS d, {_NORM('street')} AS s FROM p), "
    "r AS (SELECT *, CASE WHEN c IS NULL THEN 'insufficient' WHEN s IS NOT NULL AND building THEN 'precise' WHEN d IS NOT NULL OR s IS NOT NULL THEN 'coarse' ELSE 'insufficient' END AS kind FROM q) "
    "SELECT id, kind, CASE WHEN kind <> 'insufficient' THEN concat_ws(' ', c, d, s) END AS key FROM r"
)
def cls15_location_key(spark, sf):
    return bound(spark, sf, _PLACES).withColumn("k", sellers.location_key(F.col("city"), F.col("district"), F.col("street"), F.col("building"))).select("id", "k.kind", "k.key")


_EVIDENCE = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no time' WHEN 2 THEN 'olx_likely=1;olx_checked_at=soon' ELSE CASE event_id % 3 WHEN 0 THEN 'olx_likely=1;' WHEN 1 THEN 'olx_unreadable=1;' ELSE 'olx_other=1;' END || 'olx_checked_at=' || CAST(CAST(ts AS DATE) AS STRING) || 'T' ||
  CASE event_id % 4 WHEN 0 THEN '23:00:00' WHEN 1 THEN '23:30:00' WHEN 2 THEN '12:00:00' ELSE '11:59:59' END || 'Z' END AS evidence FROM {events}"""


@query(
    "WITH e AS (SELECT event_id, event_id % 7 < 3 AS none, event_id % 3 AS kind, 24 * 60 * date_diff('day', CAST(ts AS DATE), DATE '2024-01-16') - CASE event_id % 4 WHEN 0 THEN 1380 WHEN 1 THEN 1410 WHEN 2 THEN 720 ELSE 719.98 END AS age FROM events), "
    "l AS (SELECT * FROM (VALUES (0, 720, 'fresh_likely'), (1, 60, 'fresh_unknown'), (2, 45, 'fresh_unknown')) t(kind, most, fresh)) SELECT event_id, CASE WHEN none THEN 'absent' WHEN age BETWEEN 0 AND most - 0.001 THEN fresh ELSE 'stale' END AS state FROM e JOIN l USING (kind)"
)
def cls16_cache_state(spark, sf):
    return bound(spark, sf, _EVIDENCE).select("event_id", decisions.cache_state(F.col("evidence"), F.expr("cast('2024-01-16 00:00:00' as timestamp)")).alias("state"))


_FETCHED = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS status, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN '<p>CAPTCHA</p>' WHEN 2 THEN '<p>Access denied</p>' WHEN 3 THEN '<p>captcha</p><article>x' ELSE '<p>hm</p>' END AS html,
  CASE page_id % 5 WHEN 0 THEN html LIKE '%<article>%' WHEN 3 THEN true ELSE false END AS listed FROM {pages}"""


@query(
    f"WITH f AS ({plain(_FETCHED)}), r AS (SELECT page_id, 1 AS rank, 'transport_blocked' AS outcome FROM f WHERE status IN (403, 429) UNION ALL SELECT page_id, 2, 'transport_blocked' FROM f WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 3, 'challenge_detected' FROM f WHERE page_id % 5 = 1 "
    "UNION ALL SELECT page_id, 4, 'browser_accessible' FROM f WHERE listed AND coalesce(status, 200) < 400 UNION ALL SELECT page_id, 5, 'parser_failure' FROM f) SELECT page_id, arg_min(outcome, rank) AS outcome FROM r GROUP BY page_id"
)
def flt14_cls22_page_outcome(spark, sf):
    return bound(spark, sf, _FETCHED).select("page_id", decisions.page_outcome(F.col("status"), F.col("html")).alias("outcome"))


@query(L + f", p AS (SELECT pos, source, published_at AS pub, refreshed_at AS ref FROM l), k AS (SELECT *, {NOW} AS now FROM p), f AS (SELECT pos, CASE WHEN pub IS NULL THEN 'first_noticed' WHEN pub < now - INTERVAL 365 DAYS AND ref >= now - INTERVAL 365 DAYS THEN 'refreshed_old' WHEN pub < now - INTERVAL 365 DAYS THEN 'old_publication' WHEN pub < TIMESTAMP '1998-03-01' AND pub >= now - INTERVAL 120 DAYS THEN 'new_publication' WHEN pub < TIMESTAMP '1998-03-01' THEN 'late_discovered' ELSE 'new_publication' END AS kind FROM k) SELECT pos, kind, kind = 'new_publication' AS deliverable FROM f")
def str1_str4_str5_freshness(spark, sf):
    stamp = lambda s: F.expr(f"cast('{s}' as timestamp_ntz)")
    boundary = fresh.monitoring_boundary(stamp("1998-02-01"), stamp("1997-01-01"), stamp("1998-03-01"))
    kind = fresh.freshness(F.col("published_at"), F.col("refreshed_at"), stamp("1998-06-01"), boundary, F.expr("interval 365 days"), F.expr("interval 120 days"))
    return listings(spark, sf).select("pos", kind.alias("kind")).withColumn("deliverable", fresh.deliverable(F.col("kind"), strict=True))


_TRIES = "SELECT event_id, CAST(user_id % 14 AS INT) AS attempt, CASE WHEN event_id % 5 = 0 THEN event_id * 1000 END AS retry_after FROM {events}"


@query(f"WITH t AS ({plain(_TRIES)}) SELECT event_id, greatest(least(21600000, 120000 * CAST(pow(2, least(8, greatest(0, attempt - 1))) AS BIGINT)), coalesce(retry_after, 0)) AS delay_ms, least(21600000, 600000 * CAST(pow(2, least(8, greatest(0, attempt - 1))) AS BIGINT)) AS pause_ms FROM t")
def str25_backoff(spark, sf):
    return bound(spark, sf, _TRIES).select("event_id", backoff_ms(F.col("attempt"), F.col("retry_after")).alias("delay_ms"), backoff_ms(F.col("attempt"), F.lit(None), base=600_000).alias("pause_ms"))


_CALLS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 502 WHEN 3 THEN 400 WHEN 4 THEN 401 WHEN 5 THEN 403 WHEN 6 THEN 404 WHEN 7 THEN 408 ELSE 200 END AS status, CASE event_id % 4 WHEN 0 THEN 'Bad Request: CAN''T parse entities' WHEN 1 THEN 'Chat not found' WHEN 2 THEN '{"parameters":{"migrate_to_chat_id":-1}}' ELSE 'x' END AS body,
  CASE event_id % 6 WHEN 0 THEN ' 7 ' WHEN 1 THEN 'soon' WHEN 2 THEN '900' WHEN 3 THEN 'Tue, 16 Jan 2024 09:00:05 GMT' WHEN 4 THEN 'Mon, 15 Jan 2024 09:00:00 GMT' END AS header, CAST(event_id % 4 AS INT) AS attempt FROM {events}"""


@query(
    f"WITH c AS (SELECT *, event_id % 4 AS b FROM ({plain(_CALLS)})), k AS (SELECT * FROM (VALUES (401, 'operator_action', 'unauthorized'), (403, 'operator_action', 'forbidden'), (404, 'permanent', 'HTTP 404'), (408, 'permanent', 'HTTP 408'), (429, 'transient', 'HTTP 429'), (502, 'transient', 'HTTP 502'), (200, 'transient', 'unknown')) t(status, error_class, reason)), "
    "q AS (SELECT * FROM (VALUES (0, 'transient', 'parse_entities'), (1, 'operator_action', 'chat_not_found'), (2, 'transient', 'chat_migrated'), (3, 'permanent', 'HTTP 400')) t(b, error_class, reason)) "
    "SELECT c.event_id, coalesce(k.error_class, q.error_class, 'transient') AS error_class, coalesce(k.reason, q.reason, 'network') AS reason FROM c LEFT JOIN k ON k.status = c.status LEFT JOIN q ON c.status = 400 AND q.b = c.b"
)
def str27_delivery_failure(spark, sf):
    return bound(spark, sf, _CALLS).select("event_id", decisions.delivery_failure(F.col("status"), F.col("body")).alias("f")).select("event_id", "f.error_class", "f.reason")


@query(
    f"WITH c AS ({plain(_CALLS)}), w AS (SELECT *, (event_id % 6) AS h, [7000, NULL, 900000, 5000, 0, NULL][event_id % 6 + 1] AS wait FROM c), r AS (SELECT event_id, wait, list_filter([CASE WHEN attempt > 1 THEN 'retry_budget_exhausted' END, CASE WHEN coalesce(status, 500) IN (200, 400, 401, 403, 404) THEN 'not_transient' END, "
    "CASE WHEN h = 2 THEN 'retry_after_exceeds_cap' END, CASE coalesce(status, 0) WHEN 429 THEN 'rate_limited' WHEN 0 THEN 'network' ELSE 'server_error' END], lambda x: x IS NOT NULL)[1] AS reason FROM w) "
    "SELECT event_id, reason, CASE WHEN reason IN ('rate_limited', 'network', 'server_error') THEN coalesce(wait, 2000) ELSE 0 END AS delay_ms FROM r"
)
def str26_retry_decision(spark, sf):
    wait = decisions.retry_after_ms(F.col("header"), F.expr("cast('2024-01-16 09:00:00' as timestamp)"))
    return bound(spark, sf, _CALLS).select("event_id", decisions.retry_decision(F.col("status"), F.col("attempt"), wait).alias("r")).select("event_id", "r.reason", F.col("r.delay_ms").cast("bigint").alias("delay_ms"))


_ATTEMPTS = """SELECT event_id, CASE CAST(event_id % 13 AS INT) WHEN 0 THEN 'parser_failure' WHEN 1 THEN 'parser_failed' WHEN 2 THEN 'browser_failure' WHEN 3 THEN 'disabled' WHEN 4 THEN 'coverage_degraded' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'valid_empty' WHEN 7 THEN 'ok' WHEN 8 THEN 'http_error' WHEN 9 THEN 'transport_blocked' ELSE '' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 429 WHEN event_id % 5 = 1 THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 3 = 0 THEN 'olx' ELSE 'lun' END AS source, event_id % 4 = 0 AS browser FROM {events}"""


@query(
    f"WITH a AS ({plain(_ATTEMPTS)}), k AS (SELECT * FROM (VALUES ('parser_failure', 1, 'parser_failure'), ('browser_failure', 1, 'browser_failure'), ('disabled', 1, 'disabled'), ('coverage_degraded', 1, 'coverage_degraded'), ('rate_limited', 1, 'rate_limited'), ('valid_empty', 3, 'valid_empty'), ('ok', 3, 'ok'), ('http_error', 3, 'http_error'), ('transport_blocked', 3, 'transport_failure')) t(kind, rank, health)), "
    "r AS (SELECT event_id, rank, health FROM a JOIN k USING (kind) UNION ALL SELECT event_id, 1, CASE WHEN source = 'olx' AND browser THEN 'browser_failure' ELSE 'transport_failure' END FROM a WHERE kind = 'parser_failed' UNION ALL SELECT event_id, 2, 'rate_limited' FROM a WHERE status = 429 "
    "UNION ALL SELECT event_id, 4, CASE WHEN browser THEN 'browser_failure' WHEN status = 200 THEN 'transport_failure' ELSE 'http_error' END FROM a), f AS (SELECT event_id, arg_min(health, rank) AS health FROM r GROUP BY event_id) SELECT event_id, health, health = 'ok' OR health = 'valid_empty' AS healthy FROM f"
)
def str24_health_status(spark, sf):
    health = decisions.health_status(F.col("kind"), F.col("status"), F.col("source"), F.col("browser"))
    return bound(spark, sf, _ATTEMPTS).select("event_id", health.alias("health")).withColumn("healthy", F.col("health").isin(*decisions.HEALTHY))


@query(L + "," + _MONEY + f"SELECT pos, {_HEAD} || chr(10) || {_LABEL} || chr(10) || {_FACTS} || chr(10) || url AS message FROM f")
def snk3_fn19_message(spark, sf):
    c = F.col
    return listings(spark, sf).select("pos", F.concat_ws("\n", headline(c("property_type"), c("rooms")), texts.price_label(c("amount"), c("currency"), c("period")), facts(c("area"), c("rooms")), c("url")).alias("message"))


@query(
    "WITH t AS (SELECT doc_id, text, coalesce(list_last(string_split(text, chr(10))), '') AS tail FROM documents), r AS (SELECT *, 300 - length(tail) - 1 AS room FROM t) SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN room < 1 THEN left(tail, 300) "
    "ELSE rtrim(left(left(text, greatest(length(text) - length(tail) - 1, 0)), CAST(greatest(room - 1, 0) AS BIGINT))) || '…' || chr(10) || tail END) AS fitted_md5 FROM r"
)
def snk4_fitted_message(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.fitted(F.col("text"), 300)).alias("fitted_md5"))
