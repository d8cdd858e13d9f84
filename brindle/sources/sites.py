"""Records of the four sites as listings: one shape out of offers, cards and catalog entries, and what a page is worth.

Everything is a Column over VARIANT values or page texts; only braces are balanced in Python (`brindle.sources.pages`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import geo, sellers
from brindle.functions.urls import canonical
from brindle.sources import pages

# Category ids of homes, site addresses, markers in pages, and roles by their code.
APARTMENTS, HOUSES = 1760, 330
ITEM_CARD = '<div class="catalog-card "'
CITY_PATH, CITY_NAME, EMPTY_MARKET = "/lviv/", "(?iu)(?:львів|львов)", "(?iu)немає оголошень"
ROLES = {"1": "від посередника", "2": "від власника", "3": "від представника власника (без комісійних)", "4": "від забудовника", "5": "від представника забудовника"}
AGENT_ROLES, BUSINESS_ROLES = ("1", "3"), ("4", "5")
AGENT_CONTACTS = ["rieltor", "realtor", "agent", "agency", "intermediary"]
RESERVED_SHOPS = ["www", "m", "help", "blog", "api", "static", "ads"]
# End of the fixed values.


def value(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text(v: Column, path: str) -> Column:
    """The string at `path`; other kinds of values count as missing, and so does the empty string. The path is looked up once."""
    string = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))
    return sellers.bound(sellers.bound(F.try_variant_get(v, path, "variant"), string), lambda s: F.when(s != "", s))


def photo_links(v: Column, path: str = "$.photos") -> Column:
    """Links of both shapes, a string or an object with link or url; only http ones count, null if there are none."""
    items = F.try_variant_get(v, path, "array<variant>")
    links = F.filter(F.transform(items, lambda x: F.coalesce(text(x, "$"), text(x, "$.link"), text(x, "$.url"))), lambda x: x.rlike("(?i)^https?://"))
    return F.when(F.size(links) > 0, links)


def absolute(url: Column, path: Column) -> Column:
    site = "https://www.olx.ua"
    return (
        F.when(url.rlike("(?i)^https?://"), url).when(path.startswith("/"), F.concat(F.lit(site), path)).when(url.startswith("/"), F.concat(F.lit(site), url)).when(F.trim(url) != "", url)
    )


def offer(v: Column, only: tuple[str, ...] | None = None) -> Column:
    """An offer in either spelling of its keys: struct of the fields that a listing needs, or of those in `only`."""
    priced = F.filter(F.try_variant_get(v, "$.params", "array<variant>"), lambda p: value(p, "$.key") == "price")[0]
    either = lambda *paths: F.coalesce(*(text(v, p) for p in paths))
    fields = {
        "id": value(v, "$.id"),
        "title": text(v, "$.title"),
        "url": absolute(text(v, "$.url"), text(v, "$.urlPath")),
        "description": text(v, "$.description"),
        "created": either("$.createdTime", "$.created_time"),
        "refreshed": either("$.lastRefreshTime", "$.last_refresh_time"),
        "business": F.coalesce(value(v, "$.isBusiness", "boolean"), value(v, "$.business", "boolean")),
        "city": either("$.location.city.name", "$.location.cityName", "$.location.city"),
        "district": either("$.location.district.name", "$.location.districtName", "$.location.district"),
        "latitude": F.coalesce(value(v, "$.map.lat", "double"), value(v, "$.location.lat", "double")),
        "longitude": F.coalesce(value(v, "$.map.lon", "double"), value(v, "$.location.lon", "double")),
        "amount": F.coalesce(value(priced, "$.value.value", "double"), value(v, "$.price.regularPrice.value", "double")),
        "currency": F.coalesce(value(priced, "$.value.currency"), value(v, "$.price.regularPrice.currencyCode")),
        "category": value(v, "$.category.id", "int"),
        "user_id": value(v, "$.user.id"),
        "images": photo_links(v),
    }
    return F.struct(*(c.alias(name) for name, c in fields.items() if only is None or name in only))


#: The fields of an offer that `offer_reject` asks for.
JUDGED = ("id", "title", "city", "amount", "category")


def offer_reject(o: Column, category: int | None = None) -> Column:
    """Why an offer is no listing, the first that holds; null if it is one."""
    wrong = F.lit(False) if category is None else F.coalesce(o["category"] != category, F.lit(False))
    return (
        F.when(wrong, "wrong_category")
        .when(o["id"].isNull() | o["title"].isNull(), "adapt_failed_missing_id_or_title")
        .when(F.coalesce(F.trim(o["city"]), F.lit("")) == "", "missing_city_label")
        .when((F.coalesce(o["amount"], F.lit(0.0)) < 0) | F.isnan(F.coalesce(o["amount"], F.lit(0.0))), "schema_validation")
    )


def offer_property(o: Column) -> Column:
    """Only the category makes a home; short-term rent and sale, or a title that is itself a room or no home, unmake it."""
    reason = lambda t: sellers.rental_reject(F.coalesce(t, F.lit("")))["reason"]
    homely = lambda t: F.coalesce(t, F.lit("")).rlike("(?iu)" + sellers.HOME)
    title, body = reason(o["title"]), reason(o["description"])
    not_home = (
        F.coalesce(title.isin("short_term", "sale"), F.lit(False))
        | F.coalesce(body.isin("short_term", "sale"), F.lit(False))
        | (F.coalesce(title == "room_unit", F.lit(False)) & ~homely(o["title"]))
        | (F.coalesce(title == "excluded_primary", F.lit(False)) & ~homely(o["title"]) & ~homely(o["description"]))
    )
    return F.when(~o["category"].isin(APARTMENTS, HOUSES) | o["category"].isNull() | not_home, "unknown").when(o["category"] == APARTMENTS, "apartment").otherwise("house")


def offer_listing(o: Column) -> Column:
    """The listing of an accepted offer."""
    place = F.concat_ws(", ", o["city"], o["district"])
    return F.struct(
        F.lit("olx").alias("source"),
        o["id"].alias("source_id"),
        F.coalesce(o["url"], F.concat(F.lit("https://www.olx.ua/d/obyavlenie/-ID"), o["id"], F.lit(".html"))).alias("url"),
        o["title"].alias("title"),
        F.when(place == "", "unknown").otherwise(place).alias("place"),
        o["city"].alias("city"),
        o["district"].alias("district"),
        o["latitude"].alias("latitude"),
        o["longitude"].alias("longitude"),
        offer_property(o).alias("property_type"),
        F.try_to_timestamp(o["created"]).alias("published_at"),
        F.try_to_timestamp(o["refreshed"]).alias("refreshed_at"),
        o["amount"].alias("amount"),
        o["currency"].alias("currency"),
        o["images"].alias("images"),
        F.when(o["business"], "business").when(~o["business"], "private").alias("account"),
    )


# --- cards in a pushed payload ---------------------------------------------------------------------------------------


def card_arrays(html: Column) -> Column:
    """The texts of all `cards` arrays in the page's pushed payloads; of one that does not end, null."""
    marker = '"realties":{"cards":'
    return F.transform(F.filter(pages.pushed_payloads(html), lambda p: p.contains(marker)), lambda p: F.substring_index(p, marker, -1))


def card_valid(v: Column) -> Column:
    """An id, and every field that is there of its kind."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda path: F.try_variant_get(v, path, "variant").isNull() | F.is_variant_null(F.try_variant_get(v, path, "variant")) | kind(path).rlike("^(?:BIGINT|DOUBLE|DECIMAL)")
    return value(v, "$.id").isNotNull() & number("$.price") & number("$.roomCount")


def card_listing(card: Column, extra: Column) -> Column:
    """A card's listing; `extra`: the page's JSON-LD item at the same position, or null."""
    label = lambda c, path: F.nullif(F.trim(text(c, path)), F.lit(""))
    title = F.coalesce(label(extra, "$.name"), label(card, "$.header"), F.concat(F.lit("LUN "), value(card, "$.id")))
    description = F.coalesce(text(extra, "$.description"), text(card, "$.text"))
    at = geo.validated(value(card, "$.location[1]"), value(card, "$.location[0]"))
    contact = F.lower(label(card, "$.rieltorContact.contactType"))
    named = sellers.identity_level(label(card, "$.rieltorContact.agency.name")) == "confirmed"
    agent = F.coalesce(F.schema_of_variant(F.try_variant_get(card, "$.agency", "variant")).startswith("OBJECT"), F.lit(False)) | F.coalesce(contact.isin(AGENT_CONTACTS), F.lit(False)) | named
    street, town = text(extra, "$.address.streetAddress"), text(extra, "$.address.addressLocality")
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit("lun").alias("source"),
        value(card, "$.id").alias("source_id"),
        F.concat(F.lit("https://lun.ua/uk/realty/"), value(card, "$.id")).alias("url"),
        title.alias("title"),
        F.concat_ws(", ", street, town, label(card, "$.geo"), title).alias("place"),
        town.alias("city"),
        at["latitude"].alias("latitude"),
        at["longitude"].alias("longitude"),
        sellers.property_type(none, value(card, "$.sectionId", "int"), F.lit(None).cast("string"), title, F.coalesce(description, F.lit(""))).alias("property_type"),
        value(card, "$.price", "double").alias("amount"),
        F.when(value(card, "$.price", "double").isNotNull(), F.upper(F.coalesce(text(card, "$.currency"), F.lit("UAH")))).alias("currency"),
        value(card, "$.roomCount", "double").alias("rooms"),
        F.try_to_timestamp(F.replace(text(card, "$.insertTime"), F.lit("T"), F.lit(" "))).alias("published_at"),
        agent.alias("agent"),
    )


# --- cards in a page's HTML ------------------------------------------------------------------------------------------


def declared_count(html: Column) -> Column:
    """How many listings the page says that there are; 0 if it says that there are none."""
    shown = F.regexp_extract(html, r"(?s)data-listing-count[^>]*>(.*?)</", 1)
    number = F.regexp_extract(html, r"(?iu)data-listing-count[^>]*>\s*([\d\s]+)\s*оголошен", 1)
    return F.when(shown.rlike(EMPTY_MARKET), 0).otherwise(F.regexp_replace(number, r"\s+", "").try_cast("int"))


def resolved_place(html: Column, url: Column) -> Column:
    """Whether a page is about the place that its URL asks for."""
    label = F.concat_ws(" ", F.regexp_extract(html, "(?i)<title>([^<]+)", 1), F.regexp_extract(html, "(?s)data-listing-title[^>]*>(.*?)</", 1))
    return F.coalesce(F.parse_url(url, F.lit("PATH")).startswith(CITY_PATH) & label.rlike(CITY_NAME), F.lit(False))


def main_cards(html: Column) -> Column:
    """The cards of the main list, without the recommended ones after it; null without a list."""
    body = F.substring_index(F.regexp_extract(html, r"(?s)data-listing-items\b(.*)", 1), "data-listing-add-items", 1)
    return F.when(html.rlike(r"data-listing-items\b"), pages.pieces(body, ITEM_CARD))


def card_text(card: Column, name: str) -> Column:
    inner = F.regexp_extract(card, rf'(?s)class="{name}".*?>(.*?)</', 1)
    return pages.full(F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]+>", " "), r"\s+", " ")))


def html_card(card: Column, only: tuple[str, ...] | None = None) -> Column:
    """What stands in a card of HTML: struct of its fields, or of those in `only`; id and url null if it is none. Each is looked up once."""
    of_region = lambda region, n: pages.full(F.trim(F.split_part(region, F.lit(","), F.lit(n))))
    place = lambda region: F.struct(region.alias("region"), of_region(region, 1).alias("city"), of_region(region, 2).alias("district"))
    fields = {
        "id": F.coalesce(pages.attribute(card, "data-catalog-item-id"), pages.full(F.regexp_extract(card, r"/view/(\d+)/", 1))),
        "url": pages.full(F.regexp_extract(card, r'href="(https://rieltor\.ua/[^"]+/view/\d+/)"', 1)),
        "address": card_text(card, "catalog-card-address"),
        "place": sellers.bound(card_text(card, "catalog-card-region"), place),
        "role": pages.full(F.trim(F.regexp_extract(card, r'(?s)class="catalog-card-author-subtitle".*?<span>([^<]+)</span>', 1))),
        "latitude": sellers.bound(pages.attribute(card, "data-latitude"), geo.number),
        "longitude": sellers.bound(pages.attribute(card, "data-longitude"), geo.number),
        "amount": F.regexp_replace(card_text(card, "catalog-card-price-title"), r"[^\d]", "").try_cast("double"),
    }
    return F.struct(*(c.alias(name) for name, c in fields.items() if only is None or name in only))


#: The fields of a card of HTML without either of which it is none.
IDENTIFIED = ("id", "url")


def identified(card: Column) -> Column:
    return card["id"].isNotNull() & card["url"].isNotNull()


def linked_items(html: Column) -> Column:
    """The items of a page's first JSON-LD, in order: array of struct(url, description), the URL normalised; null without a list."""
    items = F.try_variant_get(F.try_parse_json(F.get(pages.json_ld(html), 0)), "$.itemListElement", "array<variant>")
    return F.transform(items, lambda v: F.struct(sellers.bound(text(v, "$.item.url"), canonical).alias("url"), text(v, "$.item.description").alias("description")))


def item_of(items: Column, url: Column) -> Column:
    """The last item with that URL, or null. Both are of one page, which lists some dozens at most."""
    return F.try_element_at(F.filter(items, lambda x: x["url"] == url), F.lit(-1))


def role_of_label(role: Column) -> Column:
    return F.when(role.rlike("(?iu)^власник"), "owner").when(role.rlike("(?iu)^(?:рі[єе]лтор|агент)"), "agent").otherwise("unknown")


# --- entries of a catalog in a page's state --------------------------------------------------------------------------


def role_of_code(code: Column) -> Column:
    """struct(label, kind) of an offer's role code; kind is unrecognized for a code that is not known, null for none."""
    labels = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    kind = F.when(code == "2", "owner").when(code.isin(*AGENT_ROLES), "agent").when(code.isin(*BUSINESS_ROLES), "business").when(code.isNotNull(), "unrecognized")
    return F.struct(labels[code].alias("label"), kind.alias("kind"))


def entry_listing(v: Column) -> Column:
    """An entry's listing; source_id null if it is none (no id or no path)."""
    path = F.coalesce(text(v, "$.beautiful_url"), text(v, "$.beautifulUrl"))
    city, street = F.coalesce(text(v, "$.city_name_uk"), text(v, "$.city_name")), F.coalesce(text(v, "$.street_name_uk"), text(v, "$.street_name"))
    kind = text(v, "$.realty_type_name_uk")
    named = F.concat_ws(", ", kind, street, city)
    title = F.when(named == "", F.concat(F.lit("DIM.RIA "), value(v, "$.realty_id"))).otherwise(named)
    description = F.coalesce(text(v, "$.description_uk"), text(v, "$.description"), F.lit(""))
    role = role_of_code(F.nullif(value(v, "$.characteristics_values['1437']"), F.lit("")))
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit("domria").alias("source"),
        F.when(path.isNotNull(), value(v, "$.realty_id")).alias("source_id"),
        F.when(path.startswith("http"), path).otherwise(F.concat(F.lit("https://dom.ria.com/uk/"), F.regexp_replace(path, "^/", ""))).alias("url"),
        title.alias("title"),
        city.alias("city"),
        geo.number(value(v, "$.latitude")).alias("latitude"),
        geo.number(value(v, "$.longitude")).alias("longitude"),
        sellers.property_type(value(v, "$.realty_type_id", "int"), none, kind, title, description).alias("property_type"),
        geo.number(value(v, "$.price")).alias("amount"),
        F.coalesce(text(v, "$.currency_type"), F.lit("UAH")).alias("currency"),
        F.try_to_timestamp(F.coalesce(text(v, "$.publishing_date"), text(v, "$.publishingDate"))).alias("published_at"),
        role["label"].alias("role"),
        role["kind"].alias("seller"),
        F.coalesce(geo.number(value(v, "$.agency_id")), F.lit(0.0)).alias("agency"),
    )


# --- sellers' pages --------------------------------------------------------------------------------------------------


def profile_path(html: Column) -> Column:
    """The path of the seller's public profile that a page links to, with a slash at its end."""
    found = F.regexp_extract(html, r"/uk/list/user/[A-Za-z0-9]+/?", 0)
    return F.when(found != "", F.concat(F.regexp_replace(found, "/$", ""), F.lit("/")))


def shop_url(html: Column) -> Column:
    """The seller's shop: the first subdomain linked as such, else the first with a home page; names the site keeps for itself are none."""
    hosts = lambda pattern: F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda h: F.lower(h))
    mark = 'data-testid="(?:user-profile-link|seller-link)"'
    host = r"https://([a-z0-9-]+)\.olx\.ua"
    every = F.concat(hosts(rf'(?i){mark}[^>]*href="{host}'), hosts(rf'(?i)href="{host}[^"]*"[^>]*{mark}'), hosts(rf"(?i){host}/(?:uk/)?home/?"))
    first = F.get(F.filter(every, lambda h: ~h.isin(RESERVED_SHOPS)), F.lit(0))
    return F.concat(F.lit("https://"), first, F.lit(".olx.ua/uk/home/"))


def linked_seller(state: Column, html: Column, token: Column) -> Column:
    """What a detail page says of its seller: parser_failure, confirmed_intermediary, seller_registration_year_2026, confirmed_owner or unknown."""
    ad = F.try_variant_get(state["value"], "$.ad.ad", "variant")
    matches = F.coalesce(F.regexp_extract(F.coalesce(text(ad, "$.url"), F.lit("")), r"(?i)ID([A-Za-z0-9]+)\.html", 1) == token, F.lit(False))
    kind = F.lower(F.trim(text(ad, "$.user.sellerType")))
    business = F.coalesce(value(ad, "$.business", "boolean"), value(ad, "$.isBusiness", "boolean"))
    words = F.concat_ws("\n", text(ad, "$.title"), text(ad, "$.description"))
    company = F.coalesce(text(ad, "$.user.company_name"), text(ad, "$.user.name"))
    level = F.when(sellers.identity_level(company) == "confirmed", "confirmed").otherwise(sellers.text_signals(words)["level"])
    one = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    found = sellers.classified(one("owner"), one("agent", "agency", "intermediary"), one("business"), F.lit(False), business, sellers.self_declared(words), sellers.bare_owner(words), level)
    return sellers.bound(
        found,
        lambda c: F.when(~(state["complete"] & matches), "parser_failure")
        .when(sellers.rejection_reason(c["seller_type"], c["level"]).isNotNull() & (c["level"] != "business_ambiguous"), "confirmed_intermediary")
        .when(registration_year(html) == "2026", "seller_registration_year_2026")
        .when(c["level"] == "business_ambiguous", "confirmed_intermediary")
        .when((c["seller_type"] == "owner") & (c["level"] == "platform_confirmed"), "confirmed_owner")
        .otherwise("unknown"),
    )


def registration_year(html: Column) -> Column:
    """The year since which the page says that its seller is registered, if it says one only."""
    years = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?iu)на OLX з\s+(?:\p{L}+\s+)?(20\d\d)"), F.lit(1)))
    return F.when(F.size(years) == 1, years[0])


def detail_seller(html: Column) -> Column:
    """The other site's detail page: confirmed_owner, confirmed_intermediary, unknown, or parser_failure without any of its marks."""
    at = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf'(?s)class="{name}"[^>]*>(.*?)</', 1), "<[^>]+>", " ")), F.lit(""))
    position, agency = at("offer-view-rieltor-position"), at("offer-view-rieltor-agency-link")
    role = role_of_label(position)
    return (
        F.when(position.isNull() & agency.isNull(), "parser_failure").when(agency.isNotNull() | (role == "agent"), "confirmed_intermediary").when(role == "owner", "confirmed_owner").otherwise("unknown")
    )


def profile_inventory(state: Column) -> Column:
    """A profile page's ads: struct(acquired, total_pages, total_elements, ads); not acquired without both totals as numbers."""
    top = "$.userListing.userListing"
    number = lambda path: F.when(F.schema_of_variant(F.try_variant_get(state, path, "variant")) == "BIGINT", value(state, path, "bigint"))
    pages_, total = number(f"{top}.totalPages"), number(f"{top}.totalElements")
    return F.struct((pages_.isNotNull() & total.isNotNull()).alias("acquired"), pages_.alias("total_pages"), total.alias("total_elements"), F.try_variant_get(state, f"{top}.ads", "array<variant>").alias("ads"))


# --- search URLs -----------------------------------------------------------------------------------------------------


def _with(address: Column, **params: Column) -> Column:
    """The address with the parameters that are not null, in their order."""
    query = F.concat_ws("&", *(F.concat(F.lit(name.replace("__", "-") + "="), v) for name, v in params.items()))
    return F.when(query == "", address).otherwise(F.concat(address, F.lit("?"), query))


def _olx_url(kind: Column, page: Column, owners: Column) -> Column:
    path = F.when(kind == "house", "https://www.olx.ua/uk/nedvizhimost/doma/arenda-domov/lvov/").otherwise("https://www.olx.ua/uk/nedvizhimost/kvartiry/dolgosrochnaya-arenda-kvartir/lvov/")
    fixed = F.concat(path, F.lit("?search%5Bdist%5D=15&search%5Bprivate_business%5D="), F.when(owners, "private").otherwise("business"))
    return F.when(page > 1, F.concat(fixed, F.lit("&page="), page.cast("string"))).otherwise(fixed)


def _rieltor_url(kind: Column, page: Column, owners: Column) -> Column:
    path = F.concat(F.lit("https://rieltor.ua/lviv/"), F.when(kind == "house", "houses-rent").otherwise("flats-rent"), F.lit("/"))
    return _with(path, sort=F.lit("bycreated"), f__owners=F.when(owners, "1"), page=F.when(page > 1, page.cast("string")))


def _lun_url(kind: Column, page: Column, owners: Column) -> Column:
    return _with(F.concat(F.lit("https://lun.ua/rent/lviv/"), F.when(kind == "house", "houses").otherwise("flats")), page=F.when(page > 1, page.cast("string")))


def _domria_url(kind: Column, page: Column, owners: Column) -> Column:
    home = kind == "house"
    one = lambda a, b: F.when(home, a).otherwise(b)
    return _with(F.lit("https://dom.ria.com/node/searchEngine/v2/"), category=one("4", "1"), realty_type=one("0", "2"), operation=F.lit("3"), sort=F.lit("created_at"), page=F.lit("0"), city_ids=F.lit("5"))


#: How each source's pages are addressed, by kind of home, page and whether only owners are asked for.
ADDRESSES = {"domria": _domria_url, "lun": _lun_url, "rieltor": _rieltor_url, "olx": _olx_url}


def enabled_sources(config: dict[str, bool]) -> list[tuple[str, str]]:
    """(source, transport) in their order; a browser for a source replaces plain requests, and nothing falls back."""
    found = [(s, "http") for s in ("domria", "lun", "rieltor") if config.get(s)]
    if config.get("olx_browser"):
        return [*found, ("olx", "browser")]
    return [*found, ("olx", "http")] if config.get("olx") else found


def search_url(source: Column, kind: Column, page: Column, owners: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, made in ADDRESSES.items():
        out = F.when(source == name, made(kind, page, owners)).otherwise(out)
    return out
