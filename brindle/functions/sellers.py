"""Who offers a listing: text evidence, identity names, the classifier's ordered rules, property types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.texts import normalized

_W = r"(?<![\p{L}\p{N}_])"
_E = r"(?![\p{L}\p{N}_])"

# Fixed values from here on: phrases, patterns and labels.
OWNER_PHRASES = ["від власника", "від власниці", "без посередників", "без посередника", "без комісії", "без комиссии", "от хозяина", "от собственника"]
SELF_DECLARED = ["від власника", "від власниці", "от хозяина", "от собственника", "без посередників", "без посередника"]
OWNER_SEEKING = [
    "шукаю власника", "шукаємо власника", "шукаємо власників", "шукаю власників", "looking for an owner", "looking for owners",
    "owners, contact", "owners contact us", "власники, контакт", "власники контакт", "власники, дзвон",
]
BARE_OWNER = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:власник|власниц\p{{L}}*|собственник|хозяин){_E}"
PROTECTED = [
    _W + r"(?:не|без)\s+агентств\p{L}*\s+нерухомост\p{L}*",
    _W + r"(?:не|без)\s+агенці\p{L}*\s+нерухомост\p{L}*",
    _W + r"(?:не|без)\s+агентств\p{L}*\s+недвижимост\p{L}*",
    r"я\s+не\s+рі[єе]лтор",
    r"я\s+не\s+риелтор",
    r"я\s+не\s+realtor",
    r"я\s+не\s+агент\s+(?:з|по)\s+не(?:рухомост|движимост)\p{L}*",
    r"з\s+рі[єе]лторами\s+не\s+співпрац\p{L}*",
    r"з\s+риелторами\s+не\s+(?:співпрац|сотруднича)\p{L}*",
    r"співпрац\p{L}*\s+з\s+рі[єе]лтор\p{L}*",
    r"співпрац\p{L}*\s+з\s+риелтор\p{L}*",
    r"сотруднича\p{L}*\s+с\s+риелтор\p{L}*",
    r"сотруднича\p{L}*\s+с\s+риэлтор\p{L}*",
    r"агентствам\s+недвижимости\s+не\s+\p{L}+",
    r"без\s+рі[єе]лторськ\p{L}*\s+комісі\p{L}*",
    r"без\s+риелторск\p{L}*\s+комисси\p{L}*",
    r"без\s+комісі\p{L}*",
    r"без\s+комисси\p{L}*",
    r"без\s+рі[єе]лторів",
    r"без\s+риелторов",
    r"рі[єе]лторам\s+не\s+(?:дзвонити|телефонувати)",
    r"риелторам\s+не\s+звонить",
    r"агентам\s+не\s+(?:турбувати|беспокоить)",
    _W + r"не\s+співпрац\p{L}*\s+з\s+[Аа]\.?[Нн]\.?" + _E,
    _W + r"не\s+сотруднича\p{L}*\s+с\s+[Аа]\.?[Нн]\.?" + _E,
    r"агентствам\s+нерухомості\s+не\s+\p{L}+",
    r"агенціям\s+нерухомості\s+не\s+\p{L}+",
]
#: (pattern, label); an upper-case C in the third place: letter case counts.
STRONG = [
    (_W + r"[Аа]\.?[Нн]\.?" + _E, "АН", "C"),
    (_W + r"агентство\s+нерухомост\p{L}*", "агентство нерухомості", ""),
    (_W + r"агенці\p{L}*\s+нерухомост\p{L}*", "агенція нерухомості", ""),
    (_W + r"агентство\s+(?:по\s+)?недвижимост\p{L}*", "агентство недвижимости", ""),
    (_W + r"рі[єе]лтор\p{L}*", "ріелтор", ""),
    (_W + r"риелтор\p{L}*", "риелтор", ""),
    (_W + r"риэлтор\p{L}*", "риэлтор", ""),
    (_W + r"realtors?" + _E, "realtor", ""),
    (_W + r"rieltors?" + _E, "rieltor", ""),
    (r"real[-\s]+estate\s+(?:agents?|brokers?|consultants?|managers?|experts?)" + _E, "real-estate professional", ""),
    (_W + r"я\s+рі[єе]лтор", "я рієлтор", ""),
    (_W + r"я\s+риелтор", "я риелтор", ""),
    (_W + r"я\s+realtor" + _E, "я realtor", ""),
    (_W + r"ми\s+рі[єе]лтор", "ми рієлтори", ""),
    (_W + r"ми\s+риелтор", "ми риелторы", ""),
    (_W + r"брокер\s+(?:з|по)\s+не(?:рухомост|движимост)", "брокер з нерухомості", ""),
    (_W + r"агент\s+(?:з|по)\s+не(?:рухомост|движимост)", "агент з нерухомості", ""),
    (_W + r"менеджер\s+агентств", "менеджер агентства", ""),
    (_W + r"спеціаліст\s+з\s+нерухомост", "спеціаліст з нерухомості", ""),
    (_W + r"специалист\s+по\s+недвижимост", "специалист по недвижимости", ""),
    (_W + r"представ\p{L}*\s+агентств", "представник агентства", ""),
    (_W + r"працюю\s+рі[єе]лтор", "працюю рієлтором", ""),
    (r"(?:від|от)\s+агентств\p{L}*\s+не(?:рухомост|движимост)", "від агентства нерухомості", ""),
    (r"(?:від|от)\s+агенці\p{L}*\s+нерухомост", "від агенції нерухомості", ""),
    (_W + r"[А](?:гентство|ГЕНТСТВО)\s+[Нн](?:ерухомост|ЕРУХОМОСТ)\p{L}*\s+\p{Lu}", "агентство нерухомості (бренд)", "C"),
    (_W + r"[А](?:генція|ГЕНЦІЯ)\s+[Нн](?:ерухомост|ЕРУХОМОСТ)\p{L}*\s+\p{Lu}", "агенція нерухомості (бренд)", "C"),
    (_W + r"[А](?:гентство|ГЕНТСТВО)\s+[Нн](?:едвижимост|ЕДВИЖИМОСТ)\p{L}*\s+\p{Lu}", "агентство недвижимости (бренд)", "C"),
    (r"real\s+estate\s+agency", "real estate agency", ""),
    (r"рі[єе]лторськ\p{L}*\s+комісі\p{L}*", "рієлторська комісія", ""),
    (r"риелторск\p{L}*\s+комисси\p{L}*", "риелторская комиссия", ""),
    (r"комісі\p{L}*\s+рі[єе]лтор", "комісія рієлтора", ""),
    (r"комисси\p{L}*\s+риелтор", "комиссия риелтора", ""),
    (r"комісі\p{L}*\s+агентств", "комісія агентства", ""),
    (r"комисси\p{L}*\s+агентств", "комиссия агентства", ""),
    (r"послуги\s+рі[єе]лтора", "послуги рієлтора", ""),
    (r"услуги\s+риелтора", "услуги риелтора", ""),
    (_W + r"я\s+агент" + _E, "я агент", ""),
]
#: family -> patterns
SUPPORTING = {
    "collaboration": [r"без\s+співпраці", r"(?<!не\s)співпрац", _W + "колег", _W + "спп" + _E],
    "inventory": [r"є\s+інші\s+варіанти", r"є\s+інші\s+об", r"маю\s+інші\s+варіанти", r"підбер\p{L}*\s+варіант", r"підбір\s+нерухомост", r"допоможу\s+підібрати", r"база\s+об", r"інші\s+об['']?єкти"],
    "transaction": [_W + "комісі", _W + "комисси", "ексклюзив", r"ключі\s+на\s+руках", r"ключи\s+на\s+руках", _W + "покази" + _E, _W + "показы" + _E],
    "service": [r"супровід\s+угоди", r"сопровождение\s+сделки", r"консультаці\p{L}*\s+з\s+нерухомост", r"консультаци\p{L}*\s+по\s+недвижимост"],
}
IDENTITY = [
    (_W + r"агентств\p{L}*\s+не(?:рухомост|движимост)\p{L}*", "agency realty name", ""),
    (_W + r"агенці\p{L}*\s+нерухомост\p{L}*", "agency realty name", ""),
    (r"real\s+estate(?:\s+agency)?", "real estate name", ""),
    (_W + r"(?:realty|realtor|rieltor|рі[єе]лтор|риелтор)" + _E, "realtor/realty name", ""),
    (_W + r"(?:agency|broker|estate)" + _E, "agency/broker/estate name", ""),
    (_W + "[Аа][Нн]" + _E, "АН brand", "C"),
    (_W + "(?:агентство|агенція)" + _E, "agency word name", ""),
]
SHORT_TERM = _W + r"(?:подобов\p{L}*|посуточ\p{L}*|посутков\p{L}*|погодин\p{L}*|short[\s-]*term|daily(?:\s+rent)?)" + _E
SALE = _W + r"(?:продаж\p{L}*|продаю|for\s+sale)" + _E
ROOM_UNIT = _W + r"(?:кімнат[ауи]|комнат[ауиы])" + _E
EXCLUDED = (
    _W
    + r"(?:комірк\p{L}*|комор\p{L}*|підвал\p{L}*|паркінг\p{L}*|паркомісц\p{L}*|машиномісц\p{L}*|гараж\p{L}*|земельн\p{L}*|ділянк\p{L}*|офіс\p{L}*|склад\p{L}*|кладовк\p{L}*|комерц\p{L}*|commercial|garage|land\s+plot)"
    + _E
)
HOME = _W + r"(?:квартир\p{L}*|апартамент\p{L}*|будин\p{L}*|house|apartment|flat|вілл\p{L}*)" + _E
APARTMENT = _W + r"(?:квартир\p{L}*|апартамент\p{L}*|apartment|flat)" + _E
HOUSE = _W + r"(?:будин\p{L}*|house|дом)" + _E
NOT_FOR_SALE = _W + r"не\s+(?:для\s+)?продажу" + _E
# End of the fixed values.

_FOLD = "(?iu)"
#: A match right after a negation does not count; look-behinds must be bounded.
_NOT_NEGATED = r"(?<!(?:^|[^\p{L}])(?:не(?:\s{1,4}є)?|без)\s{0,12})"


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def has_phrase(text: Column, phrases: list[str]) -> Column:
    return F.coalesce(_any([F.lower(text).contains(p) for p in phrases]), F.lit(False))


def _labels(text: Column, rules: list[tuple[str, str, str]], before: str = "") -> Column:
    """Labels of the rules that match, in the rules' order."""
    # what comes before is looked at only where the pattern itself would match
    found = [F.when(text.rlike(("(?u)" if case else _FOLD) + "(?=" + pattern + ")" + before), F.lit(label)) for pattern, label, case in rules]
    return F.array_compact(F.array(*found))


def bound(value: Column, body) -> Column:
    """`body` over `value`, which is computed once: a name in a query plan would be replaced by what it stands for, wherever it stands."""
    return F.transform(F.array(value), body)[0]


def _joined(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def masked(text: Column) -> Column:
    """Protected phrases blanked out, one after another: owners who turn intermediaries away. Most texts have none, which one search tells."""
    done = text
    for pattern in PROTECTED:
        done = F.regexp_replace(done, _FOLD + pattern, "   ")
    return F.when(text.rlike(_FOLD + _joined(PROTECTED)), done).otherwise(text)


_ANY_STRONG = "(?u)(?=" + _joined([("(?-i:" if case else "(?i:") + pattern + ")" for pattern, _, case in STRONG]) + ")" + _NOT_NEGATED


def _signals(flat: Column) -> Column:
    strong = F.when(flat.rlike(_ANY_STRONG), _labels(flat, STRONG, _NOT_NEGATED)).otherwise(F.array().cast("array<string>"))
    families = F.array_compact(F.array(*(F.when(flat.rlike(_FOLD + _joined(patterns)), F.lit(family)) for family, patterns in SUPPORTING.items())))
    return bound(strong, lambda s: F.struct(s.alias("strong"), F.when(F.size(s) > 0, F.array().cast("array<string>")).otherwise(families).alias("families")))


def text_signals(text: Column) -> Column:
    """struct(level, strong, families): confirmed by a strong phrase, likely by two supporting families."""
    found = bound(bound(normalized(F.coalesce(text, F.lit(""))), masked), _signals)
    level = lambda s: F.when(F.size(s["strong"]) > 0, "confirmed").when(F.size(s["families"]) >= 2, "likely").otherwise("unknown")
    return bound(found, lambda s: F.struct(level(s).alias("level"), s["strong"].alias("strong"), s["families"].alias("families")))


def identity_level(name: Column) -> Column:
    return F.when(F.size(_labels(normalized(F.coalesce(name, F.lit(""))), IDENTITY)) > 0, "confirmed").otherwise("unknown")


def self_declared(text: Column) -> Column:
    return has_phrase(text, SELF_DECLARED) & ~has_phrase(text, OWNER_SEEKING)


def bare_owner(text: Column) -> Column:
    return F.coalesce(text.rlike(_FOLD + BARE_OWNER), F.lit(False)) & ~has_phrase(text, OWNER_SEEKING)


def classified(platform_owner: Column, platform_agent: Column, platform_business: Column, agency: Column, business: Column, declared: Column, bare: Column, text_level: Column) -> Column:
    """struct(seller_type, level): the ordered rules; only a platform's word makes an owner."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    owner, agent, firm, agency, business, declared, bare = map(yes, (platform_owner, platform_agent, platform_business, agency, business, declared, bare))
    confirmed = yes(text_level == "confirmed")
    explicit = agent | firm | agency | confirmed
    claim = declared | (business & bare)
    split = F.when(claim, "conflict").otherwise("intermediary")
    level = (
        F.when(owner & explicit, "conflict")
        .when(owner, "platform_confirmed")
        .when(explicit, split)
        .when(claim & ~yes(text_level == "likely"), "self_declared")
        .when(business, "business_ambiguous")
        .otherwise("private_unknown")
    )
    kind = F.when(owner & ~explicit, "owner").when(owner, "unknown").when(agent, "agent").when(firm, "business").otherwise("unknown")
    return F.struct(kind.alias("seller_type"), level.alias("level"))


def rejection_reason(seller_type: Column, level: Column) -> Column:
    """The first that holds of: conflict, intermediary, agent, business, business_ambiguous; null if none does."""
    return (
        F.when(level.isin("conflict", "intermediary"), level)
        .when(seller_type.isin("agent", "business"), seller_type)
        .when(level == "business_ambiguous", level)
    )


def decision_bucket(seller_type: Column, level: Column) -> Column:
    return F.when(rejection_reason(seller_type, level).isNotNull(), "rejected").when(level == "platform_confirmed", "confirmed_owner").when(level == "self_declared", "self_declared").otherwise("unknown")


def assessment(seller_type: Column, level: Column) -> Column:
    """struct(state, send)."""
    state = (
        F.when((seller_type == "owner") & (level == "platform_confirmed"), "confirmed_owner")
        .when(seller_type.isin("agent", "business") | level.isin("conflict", "intermediary"), "confirmed_agent")
        .when(level == "self_declared", "likely_owner")
        .otherwise("unknown")
    )
    return F.struct(state.alias("state"), rejection_reason(seller_type, level).isNull().alias("send"))


def rental_reject(text: Column) -> Column:
    """struct(reason, match) why a text is no long-term home; null if it may be one."""
    flat = F.regexp_replace(text, _FOLD + NOT_FOR_SALE, " ")
    hit = lambda p: F.nullif(F.regexp_extract(flat, f"{_FOLD}({p})", 1), F.lit(""))
    made = lambda reason, p: F.struct(F.lit(reason).alias("reason"), hit(p).alias("match"))
    return (
        F.when(hit(SHORT_TERM).isNotNull(), made("short_term", SHORT_TERM))
        .when(hit(SALE).isNotNull(), made("sale", SALE))
        .when(hit(ROOM_UNIT).isNotNull(), made("room_unit", ROOM_UNIT))
        .when(hit(EXCLUDED).isNotNull() & hit(HOME).isNull(), made("excluded_primary", EXCLUDED))
    )


def property_type(realty_id: Column, section_id: Column, category: Column, title: Column, description: Column) -> Column:
    text = F.coalesce(category, title, F.lit(""))
    return (
        F.when(rental_reject(F.concat_ws("\n", title, description, category)).isNotNull(), "unknown")
        .when((realty_id == 2) | (section_id == 2), "apartment")
        .when((realty_id == 5) | (section_id == 4), "house")
        .when(text.rlike(_FOLD + APARTMENT), "apartment")
        .when(text.rlike(_FOLD + HOUSE), "house")
        .otherwise("unknown")
    )


#: Limits of a seller's inventory.
PRECISE_LIMIT, MASS_ADS, MASS_COARSE = 5, 10, 5


def inventory_verdict(acquired: Column, precise: Column, ads: Column, coarse: Column, unread_pages: Column) -> Column:
    """The limits are lower bounds, so they hold on partly read inventories too."""
    return (
        F.when(~F.coalesce(acquired, F.lit(False)), "unknown")
        .when(precise >= PRECISE_LIMIT, "seller_inventory_limit")
        .when((ads >= MASS_ADS) & (coarse >= MASS_COARSE), "seller_mass_inventory")
        .when(F.coalesce(unread_pages, F.lit(0)) > 0, "unknown")
        .otherwise("unknown")
    )


def inventory_bucket(n: Column) -> Column:
    return F.when(n <= 1, "0-1").when(n <= 4, n.cast("string")).when(n <= 7, "5-7").otherwise("8+")


BUCKETS = ["0-1", "2", "3", "4", "5-7", "8+"]


def location_key(city: Column, district: Column, street: Column, precise: Column) -> Column:
    """struct(kind, key): precise with a building, coarse with a district or street, else insufficient."""
    from brindle.functions.texts import address

    def told(p: Column) -> Column:
        kind = F.when(p["city"].isNull(), "insufficient").when(p["street"].isNotNull() & p["precise"], "precise").when(p["district"].isNotNull() | p["street"].isNotNull(), "coarse").otherwise("insufficient")
        return bound(kind, lambda k: F.struct(k.alias("kind"), F.when(k != "insufficient", address(F.concat_ws(", ", p["city"], p["district"], p["street"]))).alias("key")))

    return bound(F.struct(address(city).alias("city"), address(district).alias("district"), address(street).alias("street"), precise.alias("precise")), told)
