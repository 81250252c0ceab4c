"""Header clean-up on header lists: array<struct<pos,stage,name,value>> in, the same out.

A message keeps its headers in one row, so every step is an array expression and nothing shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import http as H
from millrace.functions.let import let
from millrace.functions.rules import applies_to_url
from millrace.policy import HeaderRule

# Headers that only concern one connection.
HOP_REQUEST = ["proxy-connection", "connection", "keep-alive", "upgrade", "trailer", "te"]
HOP_RESPONSE = ["connection", "proxy-authenticate", "keep-alive", "upgrade", "trailer"]
# Headers that may occur once.
SINGLE = ["content-length", "age", "date", "host"]
# Headers a trailer may not name.
TRAILER_FORBIDDEN = ["transfer-encoding", "content-length", "trailer"]
TRANSFORMED = "214 Transformation applied"
VIA = "1.1 unknown"
# Positions from here on belong to headers that were added.
ADDED = 100


def named(headers: Column, name: str) -> Column:
    return F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())


def has(headers: Column, name: str) -> Column:
    return F.exists(headers, lambda h: F.lower(h["name"]) == name.lower())


def last_value(headers: Column, name: str) -> Column:
    return F.try_element_at(named(headers, name), F.lit(-1))["value"]


def without(headers: Column, names: Sequence[str]) -> Column:
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(list(names)))


def header(stage: str, pos: int, name: str, value: Column | str) -> Column:
    text = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(pos).alias("pos"), F.lit(stage).alias("stage"), F.lit(name).alias("name"), text.alias("value"))


def set_header(headers: Column, stage: str, pos: int, name: str, value: Column | str) -> Column:
    """Drop all values of the header and append the new one."""
    return F.array_append(without(headers, [name.lower()]), header(stage, pos, name, value))


def set_if(condition: Column, headers: Column, stage: str, pos: int, name: str, value: Column | str) -> Column:
    return let(headers, lambda h: F.when(condition, set_header(h, stage, pos, name, value)).otherwise(h))


def first_of_single(headers: Column) -> Column:
    """Keep the first of each header that may occur once."""
    def keep(h: Column, i: Column) -> Column:
        earlier = F.exists(F.slice(headers, F.lit(1), i), lambda e: F.lower(e["name"]) == F.lower(h["name"]))
        return ~(F.lower(h["name"]).isin(SINGLE) & earlier)

    return F.filter(headers, keep)


def multiplicity(headers: Column) -> Column:
    """array<struct<name,n>> of the single headers that occur more than once."""
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.size(named(headers, n)).cast("bigint").alias("n")) for n in SINGLE])
    return F.filter(counts, lambda c: c["n"] > 1)


def drop_hop_by_hop(headers: Column, stage: str) -> Column:
    """Drop connection headers; on requests also the names listed in Connection headers."""
    if stage == "response":
        return without(headers, HOP_RESPONSE)
    lists = F.filter(headers, lambda h: F.lower(h["name"]).isin("connection", "proxy-connection"))
    tokens = F.flatten(F.transform(lists, lambda h: F.transform(F.split(h["value"], ","), lambda v: F.lower(F.trim(v)))))
    return let(tokens, lambda listed: F.filter(without(headers, HOP_REQUEST), lambda h: ~F.array_contains(listed, F.lower(h["name"]))))


def drop_dated_warnings(headers: Column) -> Column:
    """Drop warnings that cannot be read or carry another date than the message."""
    def keep(date: Column) -> Column:
        def fits(h: Column) -> Column:
            parsed = H.warning(h["value"])
            same = parsed["date"].isNull() | F.coalesce(parsed["date"] == date, F.lit(False))
            return (F.lower(h["name"]) != "warning") | (parsed.isNotNull() & same)

        return F.filter(headers, fits)

    dated = let(H.http_date(last_value(headers, "date")), keep)
    return F.when(has(headers, "warning"), dated).otherwise(headers)


def drop_forbidden_trailers(headers: Column) -> Column:
    return F.filter(
        headers, lambda h: ~((F.lower(h["name"]) == "trailer") & F.lower(h["value"]).isin(TRAILER_FORBIDDEN))
    )


def decoded(headers: Column, rewrite: Column) -> Column:
    """Headers of a response whose body has been decoded for rewriting."""

    def transfer(h: Column) -> Column:
        encoded = has(h, "transfer-encoding")
        return F.when(encoded, without(h, ["transfer-encoding", "content-length"])).when(
            rewrite, without(h, ["content-length"])
        ).otherwise(h)

    def connection(h: Column) -> Column:
        return F.when(has(h, "content-length"), h).otherwise(set_header(h, "response", ADDED, "Connection", "close"))

    def content(h: Column) -> Column:
        fixed = F.coalesce(F.lower(last_value(h, "cache-control")) == "no-transform", F.lit(False))
        plain = without(h, ["content-encoding", "content-length"])
        plain = F.when(fixed, without(plain, ["cache-control"])).otherwise(plain)
        return F.when(
            has(h, "content-encoding"), set_header(plain, "response", ADDED + 1, "Warning", TRANSFORMED)
        ).otherwise(h)

    return let(let(let(headers, transfer), connection), content)


def with_defaults(headers: Column, now: Column, expected: Column) -> Column:
    """Add Via, a missing Date and the expected content type when none of the expected ones is declared."""

    def add(h: Column) -> Column:
        via = F.array_append(h, header("response", ADDED, "Via", VIA))
        return F.when(has(h, "date"), via).otherwise(
            F.array_append(via, header("response", ADDED + 1, "Date", H.date_rfc1123(now)))
        )

    def typed(h: Column) -> Column:
        declared = last_value(h, "content-type")
        fits = F.coalesce(F.exists(expected, lambda m: F.startswith(declared, m)), F.lit(False))
        wanted = F.coalesce(F.size(expected) > 0, F.lit(False)) & ~fits
        return F.when(wanted, set_header(h, "response", ADDED + 2, "Content-Type", F.get(expected, F.lit(0)))).otherwise(h)

    return let(let(headers, add), typed)


def _template(text: str, host: Column) -> Column:
    """``$host`` and ``${host}`` filled in, ``$$`` for a dollar sign, other names kept."""
    parts = re.split(r"(\$\$|\$host\b|\$\{host\})", text)
    columns = [host if p in ("$host", "${host}") else F.lit("$" if p == "$$" else p) for p in parts if p]
    return F.concat(*columns) if columns else F.lit("")


def apply_rules(headers: Column, stage: str, url: Column, host: Column, rules: Sequence[HeaderRule]) -> Column:
    """Remove, then add, then replace headers by the rules of one stage."""
    active = [(i, r) for i, r in enumerate(rules) if r.filterstage in ("both", stage)]
    removes = [(i, r) for i, r in active if r.action == "remove"]

    def doomed(h: Column) -> Column:
        hit = F.lit(False)
        for _, rule in removes:
            by_name = h["name"].rlike(f"(?i)^(?:{rule.header})")
            hit = hit | (by_name & applies_to_url(url, rule.matchurls, ()))
        return hit

    out = F.filter(headers, lambda h: ~doomed(h)) if removes else headers
    filled = F.coalesce(host, F.lit(""))

    def change(i: int, rule: HeaderRule):
        def body(h: Column) -> Column:
            use = applies_to_url(url, rule.matchurls, ())
            if rule.action == "replace":
                use = use & has(h, rule.header)
            return F.when(use, set_header(h, stage, ADDED + i, rule.header, _template(rule.value, filled))).otherwise(h)

        return body

    for action in ("add", "replace"):
        for i, rule in active:
            if rule.action == action:
                out = let(out, change(i, rule))
    return out
