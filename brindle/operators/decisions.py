"""Ordered decisions over attempts, pages, walks and deliveries; in each the first rule that holds counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of outcomes, markers in pages, limits and times to live.
HEALTHY = ("ok", "valid_empty")
CHALLENGE = ["captcha", "checking your browser", "cf-challenge"]
BLOCKED = ["access denied", "request blocked"]
LISTING_SIGNS = ["<article>", "data-cy=\"l-card\""]
MAX_RETRIES, RETRY_CAP_MS, RETRY_DELAY_MS = 2, 10_000, 2_000
VERDICT_HOURS = {"confirmed_owner": 720, "confirmed_intermediary": 720, "unknown": 24}
LIKELY_MINUTES, UNKNOWN_MINUTES, FAILURE_MINUTES = 720, 45, 60
GATE_VERSION, MAX_AGE_MINUTES, GRACE_MINUTES = 3, 7 * 24 * 60, 60
# End of the fixed values.

yes = lambda c: F.coalesce(c, F.lit(False))


def first_rule(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds; unknown conditions do not."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def has_any(text: Column, marks: list[str]) -> Column:
    return yes(reduce(lambda a, b: a | b, (F.lower(text).contains(m) for m in marks)))


def page_outcome(status: Column, html: Column) -> Column:
    """transport_blocked, challenge_detected, browser_accessible or parser_failure; marks of a block or a challenge count only without listings."""
    listed = has_any(html, LISTING_SIGNS)
    return first_rule(
        [
            (status.isin(403, 429), "transport_blocked"),
            (has_any(html, BLOCKED) & ~listed, "transport_blocked"),
            (has_any(html, CHALLENGE) & ~listed, "challenge_detected"),
            (listed & (status.isNull() | (status < 400)), "browser_accessible"),
        ],
        "parser_failure",
    )


def delivery_failure(status: Column, body: Column) -> Column:
    """struct(error_class, reason) of a failed delivery."""
    text, code = F.lower(F.coalesce(body, F.lit(""))), F.concat(F.lit("HTTP "), status.cast("string"))
    made = lambda kind, reason: F.struct(F.lit(kind).alias("error_class"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    moved = F.try_variant_get(F.try_parse_json(body), "$.parameters.migrate_to_chat_id", "string").isNotNull()
    return first_rule(
        [
            (status.isNull(), made("transient", "network")),
            ((status == 429) | (status >= 500), made("transient", code)),
            ((status == 400) & moved, made("transient", "chat_migrated")),
            ((status == 400) & has_any(text, ["can't parse", "cant parse", "parse entities"]), made("transient", "parse_entities")),
            (status == 401, made("operator_action", "unauthorized")),
            (status == 403, made("operator_action", "forbidden")),
            ((status == 400) & text.contains("chat not found"), made("operator_action", "chat_not_found")),
            (status.between(400, 499), made("permanent", code)),
        ],
        made("transient", "unknown"),
    )


def retry_after_ms(header: Column, now: Column) -> Column:
    """Seconds, or a date in the future (one in the past: no wait); null if it is neither."""
    at = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(now))
    return F.when(F.trim(header).rlike(r"^\d+$"), F.trim(header).try_cast("bigint") * 1000).otherwise(F.when(at.isNotNull(), wait))


def retry_decision(status: Column, attempt: Column, wait_ms: Column) -> Column:
    """struct(reason, delay_ms): whether a request is tried again, and after how long; no status: the network failed."""
    passing = status.isNull() | status.isin(408, 429) | (status >= 500)
    reason = first_rule(
        [
            (attempt >= MAX_RETRIES, "retry_budget_exhausted"),
            (~passing, "not_transient"),
            (wait_ms > RETRY_CAP_MS, "retry_after_exceeds_cap"),
            (status == 429, "rate_limited"),
            (status.isNull(), "network"),
        ],
        "server_error",
    )
    delay = F.least(F.lit(RETRY_CAP_MS), F.coalesce(wait_ms, F.lit(RETRY_DELAY_MS)))
    return F.struct(reason.alias("reason"), F.when(reason.isin("rate_limited", "network", "server_error"), delay).otherwise(0).alias("delay_ms"))


def health_status(kind: Column, status: Column, source: Column, browser: Column) -> Column:
    """An attempt's result as the durable status; a 429 beats a result that says ok, but not one that names its failure."""
    return first_rule(
        [
            (kind == "parser_failure", "parser_failure"),
            ((kind == "parser_failed") & (source == "olx") & browser, "browser_failure"),
            (kind == "parser_failed", "transport_failure"),
            (kind.isin("browser_failure", "disabled", "coverage_degraded"), kind),
            ((kind == "rate_limited") | (status == 429), "rate_limited"),
            (kind.isin("valid_empty", "ok", "http_error"), kind),
            (kind.isin("transport_failure", "transport_blocked"), "transport_failure"),
            (browser, "browser_failure"),
            (status >= 400, "http_error"),
        ],
        "transport_failure",
    )


def page_evidence(n_listings: Column, has_state: Column, has_path: Column, n_raw: Column, accessible: Column, n_rejected: Column) -> Column:
    return first_rule(
        [
            (n_listings > 0, "has_listings"),
            (has_state & has_path & (n_raw == 0), "confirmed_empty"),
            (accessible | ~has_state | (n_rejected > 0), "parse_failed"),
        ],
        "unknown",
    )


def walk_outcome(mode: Column, planned: Column, fetched: Column, crossed: Column, failed: Column, ended: Column, newest: Column, target: Column) -> Column:
    """struct(reached, truncated, committed, resume_page): the watermark is committed only where the gap is closed; else the walk goes on from where it stopped."""
    seed = mode == "seed"
    reached = F.when(seed, ~failed & newest.isNotNull()).otherwise(~failed & (crossed | ended))
    failed_page = F.coalesce(F.try_element_at(planned, F.size(fetched) + 1), F.get(planned, F.lit(0)), F.lit(1))
    last = F.coalesce(F.try_element_at(fetched, F.lit(-1)), F.lit(1))
    resume = F.when(~seed & ~reached & target.isNotNull(), F.when(failed, failed_page).otherwise(last + 1))
    return F.struct(reached.alias("reached"), (~reached).alias("truncated"), F.when(reached, newest).alias("committed"), resume.alias("resume_page"))


def cursor(raw: Column) -> Column:
    """struct(target, resume_page) of a stored cursor; null for anything that is no cursor."""
    v = F.try_parse_json(raw)
    target, page = F.try_to_timestamp(F.try_variant_get(v, "$.target", "string")), F.try_variant_get(v, "$.resumePage", "double")
    return F.when(target.isNotNull() & (page >= 1) & (page == F.floor(page)), F.struct(target.alias("target"), page.cast("int").alias("resume_page")))


def cursor_text(target: Column, resume_page: Column) -> Column:
    return F.to_json(F.struct(F.date_format(target, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("target"), resume_page.alias("resumePage")))


def cache_state(evidence: Column, now: Column) -> Column:
    """absent, fresh_likely, fresh_unknown or stale, from evidence like `olx_likely=1;olx_checked_at=...`."""
    token = lambda name: F.nullif(F.regexp_extract(evidence, rf"(?:^|;){name}=([^;]*)", 1), F.lit(""))
    at = F.try_to_timestamp(token("olx_checked_at"))
    age = (F.unix_millis(now) - F.unix_millis(at)) / 60_000
    likely = yes(token("olx_likely") == "1")
    return first_rule(
        [
            (at.isNull(), "absent"),
            (age < 0, "stale"),
            (yes(token("olx_unreadable") == "1"), F.when(age < FAILURE_MINUTES, "fresh_unknown").otherwise("stale")),
            (age >= F.when(likely, LIKELY_MINUTES).otherwise(UNKNOWN_MINUTES), "stale"),
            (likely, "fresh_likely"),
        ],
        "fresh_unknown",
    )


def expires_at(verdict: Column, checked: Column) -> Column:
    """When a cached verdict runs out; a temporary failure after a minute."""
    hours = F.create_map(*(F.lit(x) for pair in VERDICT_HOURS.items() for x in pair))
    minutes = F.coalesce(F.try_element_at(hours, verdict) * 60, F.lit(1))
    return checked + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def linked_outcome(target: Column, peer: Column, cached: Column, halted: Column, rank: Column, cap: int) -> Column:
    """What is done about a linked listing's seller: peer, then cache, then the halt after a 429, then the cap on requests, then a fetch."""
    return first_rule(
        [
            (~target, "not_required"),
            (peer == "rejected", "drop"),
            (peer == "owner", "resolved"),
            (cached == "confirmed_intermediary", "cached_drop"),
            (cached.isNotNull(), F.concat(F.lit("cached_"), cached)),
            (halted, "skipped_rate_limited"),
            (rank > cap, "deferred"),
        ],
        "fetch",
    )


#: Counters of what became of linked listings' sellers, by where the verdict came from.
COUNTERS = {
    "same_cycle": ["confirmed_agent", "registration_year_excluded", "inventory_limit", "mass_inventory", "resolved"],
    "cache": ["confirmed_agent", "confirmed_owner", "registration_year_excluded", "inventory_limit", "mass_inventory", "unknown"],
    "detail": ["confirmed_agent", "confirmed_owner", "profile_likely", "registration_year_excluded", "inventory_limit", "mass_inventory", "unknown", "rate_limited", "transport_failure", "parser_failure", "capacity_deferred"],
    "skipped": ["after_rate_limit"],
    "not": ["required"],
}
# End of the fixed values.


def verification_counter(target: Column, peer: Column, cached: Column, halted: Column, rank: Column, cap: int, detail: Column) -> Column:
    """The counter of a linked listing: by its peer, the cache, the halt after a 429, the cap on requests, or what the request gave."""
    of = lambda where, verdict: F.concat(F.lit(f"{where}_"), verdict)
    return first_rule([(~target, "not_required"), (peer.isNotNull(), of("same_cycle", peer)), (cached.isNotNull(), of("cache", cached)), (halted, "skipped_after_rate_limit"), (rank > cap, "detail_capacity_deferred")], of("detail", detail))


def wait_ms(elapsed_ms: Column, interval_ms: int) -> Column:
    """Polls do not overlap: the rest of the interval is waited; the whole of it where the time that passed is not known."""
    if interval_ms <= 0:
        return F.lit(0)
    return F.when(elapsed_ms.isNull() | (elapsed_ms < 0), interval_ms).otherwise(F.greatest(F.lit(0), F.lit(interval_ms) - elapsed_ms))


def exit_code(unbounded: Column, stopped: Column, failed: Column) -> Column:
    """A daemon that is told to stop ends well, whatever failed before."""
    return F.when(unbounded & stopped, 0).when(failed, 1).otherwise(0)
