"""Extraction: records out of JSON and HTML pages, with reasons for what is rejected."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from brindle.functions import sellers

#: A string literal, which may be cut off by the end of the text, or a brace or bracket.
_STRUCTURE = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}\[\]]', re.S)
_BRACES = re.compile(r"[{}\[\]]")
_LITERAL = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def balanced(text: str, start: int, strings: bool = True) -> str | None:
    """The braces or brackets that open at `start`, up to their end; with `strings`, those inside string literals do not count."""
    depth = 0
    for found in (_STRUCTURE if strings else _BRACES).finditer(text, start):
        c = text[found.start()]
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : found.end()]
    return None


def state_blob(html: str | None, marker: str, strings: bool = True) -> str | None:
    """What is assigned to `marker`: a quoted string as it is, or balanced braces; None if there is none or it is cut off."""
    at = (html or "").find(marker)
    at = html.find("=", at + len(marker)) + 1 if at >= 0 else 0
    while at and at < len(html) and html[at].isspace():
        at += 1
    if not at or at >= len(html):
        return None
    if html[at] in "{[":
        return balanced(html, at, strings)
    if html[at] == '"':
        found = _LITERAL.match(html, at)
        return found.group() if found else None
    return None


def state_column(html: Column, marker: str, strings: bool = True) -> Column:
    """`state_blob` over a column, in Arrow batches: regular expressions cannot balance braces."""

    @pandas_udf("string")
    def scan(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: state_blob(p, marker, strings))

    return scan(html)


def balanced_column(text: Column) -> Column:
    """The array or object that each text begins with; null if it does not end."""

    @pandas_udf("string")
    def scan(values: pd.Series) -> pd.Series:
        return values.map(lambda v: balanced(v, 0) if v and v[0] in "{[" else None)

    return scan(text)


def record_with_role(raw: Column, wanted: Column, key: str, role: str) -> Column:
    """struct(found, role): whether nested JSON holds a record with `key` = wanted, and the role of it or else of its nearest ancestor."""

    def own(node: dict) -> object:
        inner = node.get("characteristics_values")
        both = [inner.get(role)] if isinstance(inner, dict) else []
        return next((str(x) for x in [*both, node.get(role)] if x not in (None, "")), None)

    def visit(node: object, above: list[dict], want: str) -> tuple[bool, str | None]:
        if isinstance(node, dict):
            if str(node.get(key)) == want:
                return True, next((r for n in [node, *above] if (r := own(n)) is not None), None)
            node, above = list(node.values()), [*above, node]
        for child in node if isinstance(node, list) else ():
            if (found := visit(child, above, want))[0]:
                return found
        return False, None

    @pandas_udf("found boolean, role string")
    def search(values: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for v, want in zip(values, ids):
            try:
                out.append(visit(json.loads(v), [], str(want)) if v else (False, None))
            except (ValueError, RecursionError):  # nested too deeply to be a page's data
                out.append((False, None))
        return pd.DataFrame(out, columns=["found", "role"])

    return search(raw, wanted)


def decoded_state(raw: Column) -> Column:
    """struct(present, complete, value): a quoted blob is decoded twice, a braced one once."""
    inner = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"s":'), raw, F.lit("}")), "$.s")).otherwise(raw)
    value = F.try_parse_json(inner)
    return F.struct(raw.isNotNull().alias("present"), value.isNotNull().alias("complete"), value.alias("value"))


def pushed_payloads(html: Column) -> Column:
    """Every string pushed into the page's stream, each decoded by itself."""
    found = F.regexp_extract_all(html, F.lit(r'push\(\[1,"((?:[^"\\]|\\.)*)"\]\)'), F.lit(1))
    return F.transform(found, lambda s: F.get_json_object(F.concat(F.lit('{"s":"'), s, F.lit('"}')), "$.s"))


def script_json(html: Column, script_id: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def json_ld(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))


def offers_like(raw: str | None, most: int) -> Iterator[tuple[str, str, int]]:
    """(id, title, depth) of objects with an id and a title, found by a bounded walk through nested JSON."""
    try:
        stack = [(json.loads(raw), 0)] if raw else []
    except (ValueError, RecursionError):  # nested too deeply to be a page's data
        return
    found = 0
    while stack and found < most:
        node, depth = stack.pop()
        if isinstance(node, dict):
            if node.get("id") is not None and isinstance(node.get("title"), str):
                found += 1
                yield str(node["id"]), node["title"], depth
            stack.extend((v, depth + 1) for v in reversed(list(node.values())) if isinstance(v, (dict, list)))
        elif isinstance(node, list):
            stack.extend((v, depth + 1) for v in reversed(node) if isinstance(v, (dict, list)))


@udtf(returnType="id string, title string, depth int")
class OfferLike:
    """`offers_like` as rows."""

    def eval(self, raw: str, most: int):
        yield from offers_like(raw, most)


def offers_like_count(raw: Column, most: int) -> Column:
    """How many rows `OfferLike` has, without a row for each."""

    @pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sum(1 for _ in offers_like(v, most))).astype("int32")

    return count(raw)


OFFER = T.StructType().add("id", "string").add("title", "string").add("price", T.StructType().add("amount", "double").add("currency", "string")).add("__bad", "string")


def parsed_offers(raw: DataFrame, column: str) -> DataFrame:
    """Rows of JSON objects as offers with a reject reason: bad_json, no_id, no_title or null."""
    offer = F.from_json(column, OFFER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = raw.withColumn("offer", offer)
    reason = (
        F.when(F.col(column).isNull() | F.col("offer.__bad").isNotNull(), "bad_json").when(F.col("offer.id").isNull(), "no_id").when(F.coalesce(F.trim("offer.title"), F.lit("")) == "", "no_title")
    )
    return rows.withColumn("reject_reason", reason)


def adapted(value: Column) -> Column:
    """One shape out of both spellings of keys: struct(id, title, created, price)."""
    pick = lambda kind, *paths: F.coalesce(*(F.try_variant_get(value, p, kind) for p in paths))
    return F.struct(
        pick("string", "$.id").alias("id"),
        pick("string", "$.title", "$.name").alias("title"),
        pick("string", "$.created_time", "$.createdTime").alias("created"),
        pick("double", "$.price.value", "$.price.regularPrice.value").alias("price"),
    )


def cards(html: Column, start: str, stop: str) -> Column:
    """Pieces of a page that begin with `start`, up to the next one; nothing after `stop` counts."""
    return pieces(F.substring_index(html, stop, 1), start)


def pieces(text: Column, start: str) -> Column:
    """What follows each `start`, which is taken as it is, up to the next one."""
    return F.filter(F.split(text, "\\Q" + start + "\\E"), lambda _, i: i > 0)


def full(c: Column) -> Column:
    """A text, which is computed once (in a lambda, `nullif` computes it twice); null if it is empty."""
    return sellers.bound(c, lambda s: F.when(s != "", s))


def attribute(card: Column, name: str) -> Column:
    return full(F.regexp_extract(card, rf'{name}="([^"]*)"', 1))


def clipped(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most so many bytes of UTF-8."""
    raw = F.encode(text, "utf-8")
    head, after = F.substring(raw, 1, most), F.substring(raw, most + 1, 1)
    inside = F.hex(after).rlike("^[89AB]")  # the next byte goes on with a character
    whole = F.regexp_extract(F.hex(head), "^((?:[0-7][0-9A-F]|[CD][0-9A-F](?:[0-9A-F]{2})|E[0-9A-F](?:[0-9A-F]{4})|F[0-9A-F](?:[0-9A-F]{6}))*)", 1)
    return F.when(inside, F.decode(F.unhex(whole), "utf-8")).otherwise(F.decode(head, "utf-8"))
