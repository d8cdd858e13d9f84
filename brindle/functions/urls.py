"""URLs: canonical form, hosts, ids inside them, and which targets may be followed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host -> platform, and where a platform's URL has the listing's id.
PLATFORMS = {"olx.ua": "olx", "rieltor.ua": "rieltor", "dom.ria.com": "domria", "lun.ua": "lun"}
ID_PATTERNS = {"olx": r"(?i)ID([A-Za-z0-9]+)\.html", "rieltor": r"(?i)/view/(\d+)(?:/|$)", "domria": r"(?i)(\d{6,})\.html$"}


def part(url: Column, what: str) -> Column:
    return F.try_parse_url(url, F.lit(what))


def host(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def canonical(url: Column) -> Column:
    """Scheme, host and path in lower case: no www., port, query, fragment or slashes at the end; else trimmed and lowered."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), r"/+$", "")
    whole = F.lower(F.concat(part(url, "PROTOCOL"), F.lit("://"), host(url), path))
    return F.coalesce(whole, F.lower(F.trim(url)))


def fingerprint(source: Column, source_id: Column, url: Column) -> Column:
    return F.concat_ws(":", source, source_id, canonical(url))


def platform(of: Column) -> Column:
    """The platform whose host `of` is or lies under, else null."""
    out = F.lit(None).cast("string")
    for name, label in reversed(PLATFORMS.items()):
        out = F.when((of == name) | of.endswith("." + name), label).otherwise(out)
    return out


def external_id(of: Column, url: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in ID_PATTERNS.items():
        out = F.when(of == label, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(out)
    return out


def detail_target(url: Column, hosts: list[str], path_pattern: str) -> Column:
    """The canonical URL if it may be followed: https, no user, standard port, an allowed host and path; else null."""
    authority = part(url, "AUTHORITY")
    standard = ~authority.contains(":") | authority.endswith(":443")
    allowed = (F.lower(part(url, "PROTOCOL")) == "https") & part(url, "USERINFO").isNull() & standard & host(url).isin(hosts) & part(url, "PATH").rlike(path_pattern)
    return F.when(allowed, canonical(url))


def same_target(asked: Column, final: Column) -> Column:
    """Whether a redirect ended at the listing that was asked for: same host and same last number in the path."""
    number = lambda u: F.regexp_extract(canonical(u), r"(\d+)(?:\.html)?$", 1)
    return F.coalesce((host(asked) == host(final)) & (number(asked) != "") & (number(asked) == number(final)), F.lit(False))
