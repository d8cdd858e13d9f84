"""Text: normalisation, redaction, escaping, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secrets and what stands in their place.
SECRETS = [
    (r"(?i)api\.telegram\.org/bot[^\s/]+", "api.telegram.org/bot[redacted]"),
    (r"\bbot\d{5,}:[A-Za-z0-9_-]{10,}\b", "[redacted-bot-token]"),
    (r"(?i)TELEGRAM_BOT_TOKEN=\S+", "TELEGRAM_BOT_TOKEN=[redacted]"),
    (r"(?i)Bearer\s+\S+", "Bearer [redacted]"),
    (r"(?i)api_key=[^&\s]+", "api_key=redacted"),
]
HTML_START = r"(?i)<(?:!doctype|html|head|body)\b"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized(text: Column) -> Column:
    """Straight quotes and dashes, single blanks."""
    return squeezed(F.translate(text, "’‘ʼ`–—−", "''''---"))


def redacted(text: Column) -> Column:
    for pattern, instead in SECRETS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def safe_error(text: Column, status: Column, most: int = 400) -> Column:
    """Short, without secrets; an HTML document becomes the status' name; blank becomes null."""
    flat = squeezed(F.replace(text, F.lit("\u0000"), F.lit("")))
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(None)).when(flat.rlike(HTML_START), F.left(status, F.lit(most))).otherwise(F.left(redacted(flat), F.lit(most)))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def tags_stripped(html: Column) -> Column:
    return squeezed(F.regexp_replace(html, r"<[^>]*>", " "))


def address(raw: Column) -> Column:
    """Lower case, dots and commas as blanks; blank becomes null."""
    return F.nullif(squeezed(F.translate(F.lower(raw), ".,", "  ")), F.lit(""))


def grouped_amount(amount: Column, decimals: int = 2) -> Column:
    """Thousands by blanks, decimals by a comma and only if there are any."""
    size = F.abs(F.round(amount, decimals))
    whole = F.translate(F.format_number(F.floor(size), 0), ",", " ")
    fraction = F.regexp_replace(F.lpad(F.round((size - F.floor(size)) * 10**decimals).cast("int").cast("string"), decimals, "0"), "0+$", "")
    body = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit(","), fraction))
    return F.when(amount < 0, F.concat(F.lit("-"), body)).otherwise(body)


#: How currencies are shown.
CURRENCY = {"USD": "$", "$": "$", "EUR": "€", "€": "€", "UAH": "грн", "ГРН": "грн", "GRN": "грн"}


def price_label(amount: Column, currency: Column, period: Column) -> Column:
    token = F.upper(F.trim(currency))
    shown = F.coalesce(F.create_map(*(F.lit(x) for pair in CURRENCY.items() for x in pair))[token], F.trim(currency))
    per = F.when(period == "day", "день").otherwise("місяць")
    text = F.when(shown.isNull() | (shown == ""), grouped_amount(amount)).when(shown.isin("$", "€"), F.concat(shown, grouped_amount(amount))).otherwise(F.concat_ws(" ", grouped_amount(amount), shown))
    return F.when(amount.isNull(), "Ціна не вказана").otherwise(F.concat_ws(" / ", text, per))


def price_from_text(text: Column) -> Column:
    """struct(amount, currency) from a shown price; null without a known currency or a positive amount."""
    flat = F.trim(F.translate(text, " ", " "))
    currency = F.when(flat.contains("$") | flat.rlike(r"(?i)\busd\b"), "USD").when(flat.contains("€") | flat.rlike(r"(?i)\beur\b"), "EUR").when(flat.rlike("(?iu)грн|uah"), "UAH")
    digits = F.regexp_replace(F.regexp_replace(flat, r"[^\d,.]", ""), "^([^,]*),", "$1.")
    amount = digits.try_cast("double")
    return F.when(currency.isNotNull() & (amount > 0), F.struct(amount.alias("amount"), currency.alias("currency")))


def fitted(text: Column, most: int) -> Column:
    """At most `most` characters, keeping the last line whole if it fits; the rest is cut with an ellipsis."""
    tail = F.substring_index(text, "\n", -1)
    head = F.left(text, F.greatest(F.length(text) - F.length(tail) - 1, F.lit(0)))
    room = F.lit(most) - F.length(tail) - 1
    clipped = F.concat(F.rtrim(F.left(head, F.greatest(room - 1, F.lit(0)))), F.lit("…\n"), tail)
    return F.when(F.length(text) <= most, text).when(room < 1, F.left(tail, F.lit(most))).otherwise(clipped)


def split_message(text: Column, most: int) -> Column:
    """Parts of at most `most` characters, cut at the last line break that fits unless that would leave less than half; the break itself goes. Null gives null.

    Every step but the last takes at least half of `most`, so the number of steps follows from the length.
    """
    def step(state: Column, _: Column) -> Column:
        rest, parts = state["rest"], state["parts"]
        head = F.left(rest, F.lit(most + 1))
        found = F.locate("\n", F.reverse(head))
        line = F.length(head) - found
        cut = F.when((found == 0) | (line < most // 2), F.lit(most)).otherwise(line)
        short = F.length(rest) <= most
        taken = F.when(short, rest).otherwise(F.left(rest, cut))
        after = F.regexp_replace(F.substring(rest, cut + 1, F.length(rest)), "^\n", "")
        return F.struct(F.when(short, F.lit("")).otherwise(after).alias("rest"), F.when(F.length(rest) > 0, F.array_append(parts, taken)).otherwise(parts).alias("parts"))

    steps = F.sequence(F.lit(0), F.floor(F.length(text) / (most // 2)).cast("int"))
    begin = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))
    return F.when(F.length(text) <= most, F.array(text)).when(text.isNotNull(), F.aggregate(steps, begin, step)["parts"])


#: Months, and what a message says.
MONTHS = ["січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня"]
CONFIRMED, UNCONFIRMED = ("✅ Власник підтверджений", "Перевірка: підтверджено платформою"), ("⚠️ Власник не підтверджений", "Перевірка: недостатньо даних")
ZONE, UNDATED, LINK = "Europe/Kyiv", "Опубліковано: дата не вказана", "Відкрити оголошення"
SITES = {"olx": "OLX", "lun": "LUN", "rieltor": "Rieltor", "domria": "DOM.RIA"}
# End of the fixed values.


def local_label(at: Column, now: Column) -> Column:
    """today, yesterday or day and month, with the time, in the zone that is shown; days are compared by an index that misjudges yesterday at ends of months. Both are UTC."""
    here, there = F.from_utc_timestamp(at, ZONE), F.from_utc_timestamp(now, ZONE)
    index = lambda t: F.year(t) * 372 + F.month(t) * 31 + F.day(t)
    day = F.when(index(here) == index(there), "сьогодні").when(index(here) == index(there) - 1, "вчора").otherwise(F.concat_ws(" ", F.day(here).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(here))))
    return F.concat_ws(", ", day, F.date_format(here, "HH:mm"))


def html_message(headline: Column, price: Column, facts: Column, confirmed: Column, published: Column, now: Column, source: Column, url: Column) -> Column:
    """A listing as a message in HTML, all values escaped."""
    seller = lambda i: F.when(confirmed, CONFIRMED[i]).otherwise(UNCONFIRMED[i])
    sites = F.create_map(*(F.lit(x) for pair in SITES.items() for x in pair))
    bold = lambda sign, text: F.concat(F.lit(f"{sign} <b>"), html_escaped(text), F.lit("</b>"))
    line = lambda sign, text: F.concat(F.lit(f"{sign} "), html_escaped(text))
    dated = F.when(published.isNull(), UNDATED).otherwise(F.concat(F.lit("Опубліковано: "), local_label(published, now)))
    link = F.concat(F.lit('🔗 <a href="'), F.replace(html_escaped(url), F.lit('"'), F.lit("&quot;")), F.lit(f'">{LINK}</a>'))
    return F.concat_ws("\n", bold("🏠", headline), F.lit(""), bold("💰", price), line("📐", facts), line("👤", seller(0)), line("🛡", seller(1)), F.lit(""), line("🕒", dated), line("🌐", sites[source]), F.lit(""), link)


def plain_message(html: Column) -> Column:
    """The same without markup: a link as its text and address."""
    return F.regexp_replace(F.regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', "$2 $1"), "</?b>", "")
